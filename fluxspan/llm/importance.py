"""Importance resampling towards a target: hashed n-gram counts weigh each document, Gumbel noise draws without replacement.

Separators collapse to single spaces; a regular expression whose matches may overlap goes through the words, each match with
up to `ORDER` words and a look-ahead at its boundary, so that one match gives the spans of all n-grams that begin at its word.
Checksums of the spans are taken for all of them at once.  Texts are scanned once: their buckets are kept in a table, which the
corpus counts and the weights both read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Words of the longest n-gram.
ORDER = 3
#: Bytes of a word, with the space before it, that the vectorised checksum reads; longer spans go through the library.
LONG = 64

_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_separators = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The space before a word begins a match, so that the search leaps from space to space; spaces end all spans.
_ngrams = regex.compile(rb" ([^ ]++)(?: ([^ ]++))?+(?: ([^ ]++))?+(?= )")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1).astype(np.uint32)
    return t


_crc = _crc_table()


def collapsed(text: bytes) -> bytes:
    """The words of a text, lower-cased, with one space between them."""
    return _separators.sub(b" ", text.translate(_lower)).strip(b" ")


def ngram_spans(data: bytes, block: int = common.CHUNK_BYTES):
    """Blocks of (starts, ends): the start of each word, and for each length up to ORDER the end of the n-gram, or -1.

    data: words that single spaces separate, a space at both ends; two spaces keep texts apart.
    """
    lo, n = 0, len(data)
    while lo < n - 1:
        cut = data.find(b" ", min(lo + block, n - 1))
        end = cut
        for _ in range(ORDER):  # the words that n-grams of this block's last words reach into
            end = data.find(b" ", end + 1) if end >= 0 else end
        found = _ngrams.finditer(data, lo, n if end < 0 else end + 1, overlapped=True)
        flat = np.fromiter((x for m in found for x in (m.start(), *m.end(1, 2, 3))), np.int64)
        rows = flat.reshape(-1, 1 + ORDER)
        rows = rows[rows[:, 0] < cut] if 0 <= cut < n - 1 else rows
        yield rows[:, 0] + 1, rows[:, 1:]
        lo = cut if 0 <= cut < n - 1 else n


def checksums(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for each end of ngram_spans; 0 where there is none."""
    out = np.zeros(ends.shape, np.uint32)
    state, at = np.full(len(starts), 0xFFFFFFFF, np.uint32), starts
    rows, slow = np.arange(len(starts)), np.zeros(len(starts), bool)
    for k in range(ends.shape[1]):
        rows = rows[ends[rows, k] >= 0]
        end = ends[:, k]
        slow[rows[end[rows] - at[rows] > LONG]] = True
        live = rows[~slow[rows]]
        step = at.copy()
        while len(live):
            state[live] = _crc[(state[live] ^ data[step[live]]) & 0xFF] ^ (state[live] >> np.uint32(8))
            step[live] += 1
            live = live[step[live] < end[live]]
        out[rows, k] = ~state[rows]
        for r in rows[slow[rows]].tolist():
            out[r, k] = zlib.crc32(raw[starts[r] : end[r]])
        at = end
    return out


def scan(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, list[bytes]]:
    """Number of words of each text, and the buckets of its features as 32-bit integers in a byte string."""
    parts = [collapsed(t) for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(p) + 2 for p in parts])))
    raw = b" " + b"  ".join(parts) + b" "
    data = np.frombuffer(raw, np.uint8)
    words, found = np.zeros(len(texts), np.int64), [[] for _ in texts]
    for starts, ends in ngram_spans(raw):
        doc = np.searchsorted(begins, starts, side="right") - 1
        words += np.bincount(doc, minlength=len(texts))
        got, some = (checksums(raw, data, starts, ends) % np.uint32(buckets)).astype("<u4"), ends >= 0
        lo, hi = np.searchsorted(doc, [np.arange(len(texts)), np.arange(1, len(texts) + 1)])
        for d in np.flatnonzero(hi > lo).tolist():
            found[d].append(got[lo[d] : hi[d]][some[lo[d] : hi[d]]].tobytes())
    return words, [b"".join(f) for f in found]


def scanned(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), n_words and found (buckets of all features, repeats included) of each row."""
    small = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def work(batches):
        for b in common.chunks(batches):
            words, found = scan(b.column("text").to_pylist(), buckets)
            short = [np.frombuffer(f, "<u4").astype(small).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(words), pa.array(short, pa.binary())], ["doc_id", "mark", "n_words", "found"])

    d = common.documents(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    return d.mapInArrow(work, "doc_id long, mark long, n_words long, found binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: a task sums its rows, and one number for each bucket reaches the driver."""
    small = "<u2" if buckets <= 1 << 16 else "<u4"

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for f in b.column("found"):
                total += np.bincount(np.frombuffer(f.as_buffer(), small), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("found").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in the target and in the corpus."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, floored; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3, ... of the drawn rows by falling score, ties by rising doc_id; null for all others.

    scores: doc_id, n_words, score, tie in a table that is read more than once; tie only keeps equal rows apart, so that no
    range of the sorting holds more than its share.  Rows are numbered inside ranges, then ranges are added up.
    """
    spark = scores.sparkSession
    drawn = scores.where(F.col("n_words") >= least_words).count() * percent // 100
    keys = [(F.col("n_words") >= least_words).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = scores.count()
    parts = max(1, min(-(-rows // 500_000), 100_000))

    def number(batches):
        at = 0
        for b in batches:
            yield b.append_column("at", pa.array(np.arange(at + 1, at + 1 + b.num_rows)))
            at += b.num_rows

    dealt = scores.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    placed = common.written(dealt.mapInArrow(number, ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", at long"))
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.max("at").alias("n")).collect()}  # one row for each range
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    rank = F.col("before") + F.col("at")
    out = placed.join(offsets, "part").withColumn("rank", F.when(rank <= drawn, rank))
    return out.drop("part", "at", "before", "tie")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, mark, n_words, n_features, weight, score and rank of every row.

    A null text has no words, weight 0 and is drawn only where least_words is 0; repeated rows each count and may each be
    drawn, with ranks that follow one another; an empty table gives no rows, an empty target gains from smoothing alone.
    Other columns are not read.
    """
    found = common.written(scanned(docs, buckets, id_col, text_col))
    goal = scanned(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_col}`").alias("text")), buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(goal, buckets))
    small = "<u2" if buckets <= 1 << 16 else "<u4"

    def work(batches):
        for b in batches:
            own = [np.frombuffer(f.as_buffer(), small) for f in b.column("found")]
            n = np.array([len(f) for f in own], np.int64)
            w = np.array([gain[f].sum() for f in own], np.int64)
            z = np.array([noise(i, seed) for i in b.column("doc_id").to_pylist()], np.int64)
            arrays = [b.column("doc_id"), b.column("mark"), b.column("n_words"), pa.array(n), pa.array(w), pa.array(w + z)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "n_words", "n_features", "weight", "score"])

    schema = "doc_id long, mark long, n_words long, n_features long, weight long, score long"
    scores = common.written(found.mapInArrow(work, schema).withColumn("tie", F.monotonically_increasing_id()))
    common.discard(found)
    return ranked(scores, percent, least_words)


def importance_report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row, as `importance` finds them."""
    return importance(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns, and _rank (the smallest) and _copies (equal rows that were drawn), which
    replace input columns of these names.  Equal ids and texts are one document here."""
    all_ = importance(docs, target, id_col=id_col, text_col=text_col, **options)
    drawn = all_.where("rank is not null").groupBy(F.col("doc_id").alias("_i"), F.col("mark").alias("_m")).agg(F.min("rank").alias("_rank"), F.count("*").alias("_copies"))
    names = [c for c in docs.columns if c not in ("_rank", "_copies")]
    row = docs.dropDuplicates([id_col, text_col]).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    same = F.col(f"_row.`{id_col}`").cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(F.col(f"_row.`{text_col}`").cast("binary")) == F.col("_m"))
    return row.join(drawn, same).select("_row.*", "_rank", "_copies")


def report_sql(buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> str:
    """The same report as SQL: checksums go through the texts' hexadecimal digits, four bits in a step."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array(coalesce({lower}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    runs = " union all ".join(f"select tab, id, unnest(list_transform(range(1, len(w) - {k - 1} + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) as f from t where len(w) >= {k}" for k in range(1, ORDER + 1))
    crc = common.crc32_sql("h")
    return f"""
    with t as (select 'd' as tab, doc_id as id, {words} as w from documents union all select 'b', item_id, {words} from benchmark),
    g as ({runs}),
    names as (select f, hex(encode(f)) as h from (select distinct f from g)),
    b as (select f, {crc} % {buckets} as bucket from names),
    n as (select bucket, count(*) filter (tab = 'd') as s, count(*) filter (tab = 'b') as t from g join b using (f) group by bucket),
    gain as (select bucket, floor(1000 * ln(((t + 1) * ((sum(s) over ()) + {buckets}))::double / ((s + 1) * ((sum(t) over ()) + {buckets}))::double))::bigint as gain from n),
    w as (select id, count(*) as n_features, sum(gain)::bigint as weight from g join b using (f) join gain using (bucket) where tab = 'd' group by id),
    h as (select id, len(w) as words, ('0x' || substr(sha256('{seed}:' || id), 1, 8))::bigint as h from t where tab = 'd'),
    s as (select h.id, words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
          (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296))))::bigint as score from h left join w on h.id = w.id),
    r as (select *, row_number() over (order by words >= {least_words} desc, score desc, id) as r, floor({percent} * sum((words >= {least_words})::int) over () / 100) as most from s)
    select id as doc_id, n_features, weight, score, case when r <= most then r end as rank from r"""
