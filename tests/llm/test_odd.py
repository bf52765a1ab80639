"""Odd rows through every operator but near-deduplication: long texts, nulls, repeats, clashing columns, empty tables."""

import hashlib

import numpy as np
import pytest

from fluxspan.llm import bpe, quality, registry, toxicity
from fluxspan.llm import decontamination as dec
from fluxspan.llm import line_dedup as lines
from fluxspan.llm import token_counts, token_store
from fluxspan.llm.substring_dedup import substring_dedup
from fluxspan.llm.suffix_dedup import suffix_dedup

PATH = registry.tokenizer_path()
LONG = "\n".join(" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[:7] for j in range(12)) for k in range(55_000))  # over 5 MB
ITEM = "one two three four five six seven eight nine ten eleven"
ROWS = [(1, LONG, "a"), (2, f"x {ITEM} y", "b"), (2, f"x {ITEM} y", "b"), (None, f"x {ITEM} y", None), (None, None, None), (3, "", "c"), (4, "a", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    """A frame with extra columns of the names that operators use."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for c in ("mark", "n_words", "kept", "score", "ids", "tie", "starts", "_kept", "k1", "h", "bands", "node"):
        df = df.withColumn(c, df.doc_id)
    return df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i", ITEM), ("j", None), ("i", ITEM)], "item_id string, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None), (2, 1, 0), (2, 0, 1), (4, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


WORDS = 55_000 * 12
CASES = {
    "op1": (lambda d, i, q: substring_dedup(d), "n_words", [0, 0, 1, 13, 13, 13, WORDS]),
    "op2": (lambda d, i, q: suffix_dedup(d), "n_bytes", [0, 0, 1, 59, 59, 59, len(LONG)]),
    "op3": (lambda d, i, q: dec.contamination(d, i), "n_hit", [0, 0, 0, 0, 11, 11, 11]),
    "op4": (lambda d, i, q: quality.verdicts(d, quality.train(d, q)), "n_words", [0, 0, 1, 13, 13, 13, WORDS]),
    "op5": (lambda d, i, q: toxicity.toxicity(d, q), "predicted", None),
    "op6": (lambda d, i, q: token_store.store_digests(d, PATH, 1, True), "n_tokens", None),
    "op8": (lambda d, i, q: bpe.token_digests(d, PATH), "n_tokens", None),
    "op9": (lambda d, i, q: token_counts.token_counts(d, PATH, 49407, True), "n_tokens", None),
    "op10": (lambda d, i, q: lines.line_report(d, 2), "n_lines", [0, 1, 1, 1, 1, 1, 55_000]),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(odd, items, labels, name):
    run, column, want = CASES[name]
    got = run(odd, items, labels).collect()
    assert len(got) == len(ROWS)
    if want is not None:
        assert sorted(r[column] for r in got) == sorted(want)
    twice = [tuple(v for k, v in r.asDict().items() if k != "start") for r in got if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert run(odd.limit(0), items, labels).count() == 0


def test_token_files_agree_with_encoding(odd):
    stored = {(r.doc_id, r.n_tokens) for r in token_store.store_digests(odd, PATH, 1, True).collect()}
    assert stored == {(r.doc_id, r.n_tokens + 1) for r in bpe.token_digests(odd, PATH).collect()}


def test_labels_of_one_kind_or_none(odd, labels):
    docs = odd.where("doc_id = 2 or doc_id = 4")
    none, good = labels.limit(0), labels.where("quality = 1 and toxic = 0")
    assert quality.keep_good(docs, quality.train(docs, none)).count() == quality.keep_good(docs, quality.train(docs, good)).count() == 2
    bad = quality.train(docs, labels.where("quality = 0"))
    assert quality.keep_good(docs, bad).count() == 0
    for some, score in ((none, 0), (good, 0), (labels.where("toxic = 1"), 1)):
        assert {round(r.score) for r in toxicity.scores(docs, toxicity.train(docs, some)).collect()} == {score}


def test_many_lines_in_one_document(spark):
    """A hundred thousand lines, every other one boilerplate."""
    rows = [(0, "\n".join("shared" if k % 2 else f"own {k}" for k in range(100_000)), "s0")] + [(k, "shared\nmore", f"s{k}") for k in range(1, 4)]
    got = {r.doc_id: r for r in lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3).collect()}
    assert got[0]._removed == 50_000 and got[0]._kept == "\n".join(f"own {k}" for k in range(0, 100_000, 2))
    assert got[1]._kept == "" and got[1]._removed == 2


def test_code_points_beyond_two_bytes():
    """Hangul, Han and emoji are told apart from each other and from Latin letters."""
    words = ["abcd", "\u8061\u8062\u8063\u8064", "\uac00\uac01\uac02\uac03", "\U0001f600\U0001f601\U0001f602\U0001f603", "\U0001f600\U0001f601\U0001f602\U0001f604"]
    codes = [set(toxicity.features([w])[1].tolist()) for w in words]
    assert not codes[0] & codes[1] and not codes[0] & codes[2] and not codes[1] & codes[2] and codes[3] != codes[4]
    bags = [["\uac00\uac01\uac02", "x"], ["y", "zz"]] * 12
    machine = toxicity.fit(bags, np.array([1, 0] * 12), np.array([5] * 24))
    margins = machine.margins(["\uac00\uac01\uac02", "\u8061\u8062\u8063", "zz"])
    assert margins[0] > 0 > margins[1] and margins[2] < 0
