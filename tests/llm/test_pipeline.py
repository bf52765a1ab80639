import hashlib
import re

import numpy as np
import tokenizers

import corpus_pipeline
from fluxspan.llm import common, quality, registry


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf))
        seen.append((name, docs.count()))
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    counts = [n for _, n in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids))


def test_stages_on_odd_rows(spark, sf):
    """Empty tables and null columns pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:6] + "a" for i in range(60)) + "."
    for rows in ([], [(None, None, None, None, None), (1, text, None, None, None), (1, text, None, None, None), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, sf))
        assert docs.count() <= len(rows)


def brute_pipeline(docs, labels, items, forest):
    """The five stages one after another on plain rows {doc_id: text}, each by its definition."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sources = {d: s for d, _, s in docs}
    raw = {d: (t or "").encode() for d, t, _ in docs}
    # quality: repeated 5-word windows, few words, and the trees' verdict
    kept = {}
    for d, t in raw.items():
        w = t.split()
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeated = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and forest.probability(quality.statistics([t])[1])[0] >= 0.5:
            kept[d] = t
    # lines on ten sites or more
    sites = {}
    for d, t in kept.items():
        for line in t.split(b"\n"):
            if line.split() and sources[d] is not None:
                sites.setdefault(line, set()).add(sources[d])
    kept = {d: b"\n".join(x for x in t.split(b"\n") if len(sites.get(x, ())) < 10) for d, t in kept.items()}
    # near-duplicates: one of each component stays
    sets = {}
    for d, t in kept.items():
        w = t.translate(lower).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in kept}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(kept)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {d: t for d, t in kept.items() if find(d) == d}
    # benchmark windows
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for t in items:
        w = word.findall((t or "").encode().translate(lower))
        for win in [w] if 0 < len(w) < 10 else [w[i : i + 10] for i in range(len(w) - 9)]:
            windows.setdefault(len(win), set()).add(tuple(win))
    for d, t in list(kept.items()):
        spans = [m.span() for m in word.finditer(t.translate(lower))]
        w = [t.translate(lower)[a:b] for a, b in spans]
        hit = [False] * len(w)
        for n, wins in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit[i : i + n] = [True] * n
        if sum(hit) > 0.5 * len(w):
            del kept[d]
        elif any(hit):
            out, at, k = b"", 0, 0
            while k < len(w):
                j = k
                while j < len(w) and hit[j]:
                    j += 1
                if j > k:
                    out, at = out + t[at : spans[k][0]], spans[j - 1][1]
                k = j + 1
            kept[d] = out + t[at:]
    library = tokenizers.Tokenizer.from_file(registry.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    rows = []
    for d, t in kept.items():
        e = library.encode(t.decode(), add_special_tokens=False).ids
        decoded = library.decode(e, skip_special_tokens=False)
        rows.append((d, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(rows)


def test_run_equals_brute_force(spark, sf):
    docs, labels, items = (common.table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    forest = quality.train(docs, labels)
    want = brute_pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()], None, [r.text for r in items.collect()], forest)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert len(got) > 100 and got == want
