"""Substring, suffix, near and line deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from fluxspan.llm import line_dedup, near_dedup, repeats
from fluxspan.llm.near_dedup import near_classes, one_of_each
from fluxspan.llm.substring_dedup import substring_dedup, word_method
from fluxspan.llm.suffix_dedup import byte_method, suffix_dedup

WORDS = ["ab", "c", "the", "of", "été", "x\x00", "日本", "foo", "bar,", "q" * 30]
SCHEMA = "doc_id long, text string"


def corpus(seed, n=80):
    rng = random.Random(seed)
    passage, docs = " ".join(rng.choices(WORDS, k=60)), []
    for d in range(n):
        w = rng.choices(WORDS, k=rng.choice([0, 3, 20, 60, 150]))
        r = rng.random()
        if r < 0.3:
            w = w[:10] + passage.split(" ") + w[10:]
        elif r > 0.9 and docs:
            w = (docs[-1][1] or "").split(" ")
        elif r > 0.85:
            w = ["dup"] * rng.randint(1, 150)
        docs.append((d * 7 - 300, " ".join(w) if rng.random() > 0.05 else None))
    rng.shuffle(docs)
    return docs


def removed(units, size):
    """Mask of each document's units covered by a window that starts earlier."""
    seen, masks = {}, {}
    for d in sorted(units):
        for i in range(len(units[d]) - size + 1):
            seen.setdefault(tuple(units[d][i : i + size]), (d, i))
    for d, u in units.items():
        m = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] != (d, i):
                m[i : i + size] = [True] * size
        masks[d] = m
    return masks


@pytest.mark.parametrize("buckets", [None, 7])
def test_substring(spark, buckets):
    docs = corpus(1)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    units = {d: (t or "").encode().split() for d, t in docs}
    masks = removed(units, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, buckets=buckets).collect()}
    assert got == {d: (len(u), sum(masks[d]), hashlib.sha256(b" ".join(w for w, m in zip(u, masks[d]) if not m)).hexdigest()) for d, u in units.items()}


@pytest.mark.parametrize("buckets", [None, 7])
def test_suffix(spark, buckets):
    docs = corpus(2)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    units = {d: (t or "").encode() for d, t in docs}
    masks = removed(units, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, buckets=buckets).collect()}
    spans = lambda m: sum(x and not y for x, y in zip(m, [False, *m]))
    assert got == {d: (len(u), sum(masks[d]), spans(masks[d]), hashlib.sha256(bytes(b for b, m in zip(u, masks[d]) if not m)).hexdigest()) for d, u in units.items()}


def test_hot_passages_in_parts(spark):
    """A passage that all chunks hold, and a common phrase in changing contexts, settle in parts that are then compared."""
    rng = random.Random(12)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(n))
    passage, phrase = own(60), own(6)
    docs = [(d, " ".join((own(15), passage if d % 3 else "", phrase, own(20), phrase, own(12)))) for d in range(60)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(20, "doc_id")
    keyed_docs = repeats.keyed(df, "doc_id", "text").select("doc_id", "mark", "text")
    for make, run, units, size in ((word_method, substring_dedup, lambda t: t.encode().split(), 20), (byte_method, suffix_dedup, lambda t: t.encode(), 100)):
        _, hot, fills = repeats.sample_of(keyed_docs, 10_000, make(), 9)
        assert len(hot) and (fills > 1).all()
        masks = removed({d: units(t) for d, t in docs}, size)
        assert {r.doc_id: r.n_removed for r in run(df, buckets=9).collect()} == {d: sum(m) for d, m in masks.items()}


def test_suffix_order():
    """A whole order, also of strings that are beginnings of others, end in NUL, or repeat."""
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"ab\x00", k=rng.choice([0, 1, 7, 8, 9, 17, 40]))) for _ in range(400)] + [b"a" * k for k in (7, 8, 9, 16, 17)] * 2
    ends = np.cumsum([len(x) for x in strings])
    data = np.frombuffer(b"".join(strings) + bytes(16), np.uint8)
    order, same = repeats.suffix_order(data, ends - [len(x) for x in strings], ends)
    got = [strings[k] for k in order]
    padded = [x.ljust(48, b"\x00") for x in got]
    assert [(p, len(x)) for p, x in zip(padded, got, strict=True)] == sorted((x.ljust(48, b"\x00"), len(x)) for x in strings)
    assert same.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]


def test_odd_rows(spark):
    """Null ids, repeated rows, clashing columns, empty tables."""
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, long, 1), (1, long, 2), (1, long, 2), (2, None, 3), (3, "", 4)], "doc_id long, text string, n_words long")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [(False, 0, 0), (True, 1, 40), (True, 1, 40), (True, 2, 0), (True, 3, 0)]
    near = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id, r.kept) for r in near_classes(df, 2).collect())
    assert near == [(False, 0, 1, False), (True, 1, 1, True), (True, 1, 1, True), (True, 2, 2, True), (True, 3, 3, True)] or near[0][:3] == (False, 0, 1)
    empty = df.limit(0)
    assert substring_dedup(empty).count() == suffix_dedup(empty).count() == near_classes(empty).count() == 0


def shingles(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (text or "").split()]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def classes(docs, k):
    sets, parent = [(d, shingles(t, k)) for d, t in docs], {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("nodes, size", [(1000, 8 << 20), (5, 2000)])
def test_near(spark, monkeypatch, nodes, size):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    monkeypatch.setattr(near_dedup, "SLAB_PAIRS", 20 * nodes)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, docs = [rng.choices(vocabulary, k=rng.choice([8, 40, 90])) for _ in range(8)], []
    for d in range(220):
        w = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.choice([0, 1, 2, 30]))
        for _ in range(rng.choice([0, 1, 2, 3, 5]) if w else 0):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((d * 3 + 1, " ".join(w) if rng.random() > 0.03 else None))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    want = classes(docs, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_classes(df, 2).collect()} == want


def test_near_hot_bucket(spark, monkeypatch):
    """Documents that share half of their shingles fall into common buckets, though few are similar."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 50)
    rng = random.Random(8)
    vocabulary, shared = [f"w{i}" for i in range(5000)], [f"s{i}" for i in range(40)]
    docs = []
    for d in range(300):
        w = shared + rng.choices(vocabulary, k=30)
        docs.append((d, " ".join(w)))
        if d % 10 == 0:  # a chain of small steps away from the shared text
            for k in range(3):
                w[40 + 2 * k] = rng.choice(vocabulary)
                docs.append((1000 + 3 * d + k, " ".join(w)))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_classes(df, 2).collect()} == classes(docs, 2)


def test_near_given_documents(spark):
    """No link is lost on real documents, and equal ids keep their smallest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = classes([tuple(r) for r in docs.collect()], 2)
    got = near_classes(docs, 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_filled_bins():
    """Filling ends also for one shingle, and equal sets have equal bins."""
    owner, value = near_dedup.shingle_sets([b"a", b"a a", b"", b"A", b"b c d"], 2)
    bare, full = near_dedup.minima(owner, value, 5)
    gone = np.uint64((1 << 64) - 1)
    assert (full[[0, 1, 3, 4]] != gone).all() and (full[2] == gone).all()
    assert (full[0] == full[3]).all() and ((bare[0] != gone).sum(), (bare[4] != gone).sum()) == (1, 2)
    floors = near_dedup.sketch_floors(80)
    assert (np.diff(floors) >= 0).all() and floors[200] < 130 and floors[20] < 8


def test_one_of_each(spark):
    same = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, same, "a"), (1, same, "b"), (2, "other words", "c")], "doc_id long, text string, lang string")
    assert sorted(one_of_each(df).collect()) == [(1, same, "b"), (2, "other words", "c")]


def test_one_of_each_without_ids(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, same, "a"), (None, same, "b"), (None, "quite other words without an id", "c"), (5, same, "d"), (5, "a text of its own under a shared id", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.lang for r in one_of_each(df).collect()) == ["a", "c", "e"]


def test_lines(spark):
    rows = [(i, f"Licence line\nown {i}\n\n \nshared", f"s{i % 12}") for i in range(24)] + [(90, "Licence line", None), (91, None, "s1"), (92, "", "s1"), (93, "own 1\nlate", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: (r._kept, r._lines, r._removed) for r in line_dedup.without_boilerplate(df, 12).collect()}
    assert out[5] == ("own 5\n\n ", 5, 2) and out[90] == ("", 1, 1)
    assert out[91] == (None, 0, 0) and out[92] == ("", 1, 0) and out[93] == ("own 1\nlate", 2, 0)
    assert {r.doc_id: r._removed for r in line_dedup.without_boilerplate(df, 13).collect()}[5] == 0
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_lines_ties_and_names(spark):
    """Exactly at the threshold with null sites; repeated rows; input columns with the names that are used inside."""
    rows = [(i, "own %d\nshared" % i, f"s{i % 3}" if i < 6 else None, i, "x", [i]) for i in range(9)] + [(1, "own 1\nshared", "s1", 5, "y", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 long, _kept string, _gone array<int>")
    for sites, kept in ((3, "own 1"), (4, "own 1\nshared")):
        out = line_dedup.without_boilerplate(df, sites)
        assert out.columns == ["doc_id", "text", "source", "k1", "_gone", "_kept", "_lines", "_removed"]
        got = [r for r in out.collect() if r.doc_id == 1]
        assert [(r._kept, r._lines, r._removed, r._gone) for r in got] == [(kept, 2, 4 - sites, [1])] * 2
    null = [r._removed for r in line_dedup.without_boilerplate(df, 3).collect() if r.source is None]
    assert null == [1, 1, 1]


def test_lines_sql(spark, sf):
    import duckdb

    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, line_dedup.line_report(docs, 3).collect())) == sorted(duckdb.sql(line_dedup.report_sql(3)).fetchall())
