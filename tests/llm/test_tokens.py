"""Encoding, token files and separator counts against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxspan.llm import bpe, common, token_counts, token_store
from fluxspan.llm.encoder import LibraryEncoder
from fluxspan.llm.word_ids import WordIds, letter_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|>", "<|startoftext|>", "x<|endoftext|>y", "İstanbul", "naïvé", "日本語", "é", "ﬁ", "Σας ΟΔΟΣ", "\x1c\x1d", " ", "a b", "don't've", "123abc", "ß", "a\x00b", "🙂🙂", "한국", "ª²", "<|endoftext", "", " \n\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_speculation_is_exact(library, sf):
    import duckdb

    rng = random.Random(1)
    texts = [r[0] or "" for r in duckdb.sql(f"select text from '{sf}/documents.parquet' limit 60").fetchall()] + ODD + [" ".join(rng.choices(ODD, k=9)) for _ in range(50)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz'!.", k=rng.randint(1, 30))) for _ in range(3000)]
    coder = bpe.SpeculativeBPE(PATH)
    got = coder.encode([t.encode() for t in texts])
    assert 0 < coder.failed
    for t, (ids, decoded), e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert decoded.decode() == library.decode(e.ids, skip_special_tokens=False)
    assert coder.encode([t.encode() for t in texts]) == got


@pytest.mark.parametrize("literal", [False, True])
def test_pieces_of_words(literal):
    """Words cut between letters and signs, remembered in a table that is too small, give the library's ids."""
    rng = random.Random(1)
    letters = list("aAbZzsStT09'!\"#,.<|>()=~^`é×÷ñÑİßŁ.'-_̸̨́…—日本한🙂\x00\x1c  ﬁΣςª²µǅʰɐ") + ["'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))).encode() for _ in range(6000)]
    apart, whole = LibraryEncoder(PATH, True, literal), LibraryEncoder(PATH, False, literal)
    assert apart.words.words is letter_pieces
    apart.words = WordIds(apart.kind, letter_pieces, slots_log2=6, most=2)
    for lo in range(0, len(texts), 500):
        assert apart.encode(texts[lo : lo + 500], b"end") == whole.encode(texts[lo : lo + 500], b"end")
    assert apart.encode([]) == [] and apart.encode([b"", b" "]) == [b"", b""]


def test_equal_hashes(monkeypatch):
    """Spans whose hashes collide are told apart by their bytes."""
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abc", k=rng.choice([1, 3, 7, 8, 9, 16, 17, 63, 64, 65, 70, 130]))) for _ in range(300)]
    some = rng.choices(words, k=3000)
    data, _ = common.joined([b" ".join(some)])
    s, e = common.word_spans(data)
    plain = common.span_hashes
    for hashes in (plain, lambda *a: plain(*a) % np.uint64(50)):
        monkeypatch.setattr(common, "span_hashes", hashes)
        first, number = common.distinct_spans(data, s, e)
        assert [some[k] for k in first[number]] == some and len(first) == len(set(some))


def test_pairs_match_merging():
    coder = bpe.SpeculativeBPE(PATH)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 49406, 4000)
    inner = [t for t in a.tolist() if not coder.tokens[t].endswith("</w>") and coder.stands[t]]
    b = [t for t in rng.integers(0, 49406, 4000).tolist() if coder.stands[t]]
    n = min(len(inner), len(b))
    ok = coder.compatible(np.array(inner[:n]), np.array(b[:n]))
    byte_of = {c: x for x, c in bpe.byte_letters().items()}
    for x, y, good in zip(inner[:n], b[:n], ok.tolist(), strict=True):
        last = coder.tokens[y].endswith("</w>")
        raw = bytes(byte_of[c] for c in coder.tokens[x] + coder.tokens[y].removesuffix("</w>"))
        assert (coder.merge(raw, last) == [x, y]) == good


def test_round_trip_frames(spark):
    df = spark.createDataFrame([(1, "Hello  World"), (None, None), (2, "")], "doc_id long, text string")
    out = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(df, PATH).collect()}
    assert out[1][1] == b"hello</w> world</w>" and out[None] == out[2] == (b"", b"")


def mixed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.union(spark.createDataFrame([(None, "a b"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "x<|endoftext|> y")], "doc_id long, text string"))


def test_token_files(spark, sf, library, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_TEXT_BYTES", 100_000)
    docs = mixed(spark, sf)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(token_store.store_digests(docs, PATH, 1, True).collect(), key=lambda r: r.start)
    start = 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert tuple(g) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    manifest = token_store.write_tokens(docs.limit(50), PATH, 1, True)
    some = docs.limit(50).collect()[7]
    found = []
    for row in manifest.collect():
        try:
            found.append(token_store.read_document(row.uri, some.doc_id))
        except KeyError:
            pass
    assert token_store.store_digests(docs, PATH, 1, True).select(F.spark_partition_id()).distinct().count() > 1  # not joined by adaptive execution
    assert found == [[*library.encode(some.text, add_special_tokens=False).ids, 1]]
    assert token_store.store_digests(docs.limit(0), PATH, 1, True).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_separator_counts(spark, sf, block):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    docs = mixed(spark, sf).repartition(3)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.token_counts(docs, PATH, 49407, True, block=block).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), PATH, 49407, True).count() == 0
