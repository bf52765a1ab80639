"""Line deduplication across sites: boilerplate is a line seen on many distinct sites.

Only DataFrame functions run here.  HyperLogLog sketches of the sites of each line hash merge by aggregation; lines whose
estimate is clearly above the threshold are boilerplate, clearly below aren't, and those near it get exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: log2 of the buckets of a sketch, and the relative distance from the threshold inside which counts are exact.
#: Three standard errors of 2**8 buckets are 0.2, and sketches of few sites are exact.
SKETCH_LOG2, NEAR = 8, 0.25
#: Rows of the most frequent line for each of the parts that lines are spread over when they meet their verdicts, and how
#: many parts there are at most; what is still skewed then is left to adaptive execution.
SALT_ROWS, MOST_SALTS = 1_000_000, 64
RESULTS = ["_kept", "_lines", "_removed"]


def line_hashes(docs: DataFrame, text_col: str = "text", **keep) -> DataFrame:
    """One row for each line that has a word: its position, a 64-bit hash and a 32-bit check of its bytes, and the `keep` columns."""
    lines = docs.select(*[c.alias(k) for k, c in keep.items()], F.posexplode(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)).alias("pos", "line"))
    # white space is 0x20 and 0x09-0x0D
    return lines.where(F.length(F.translate("line", " \t\x0b\x0c\r", "")) > 0).select(*keep, "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """h, h2 and number of rows n of the lines on at least `sites` distinct sites.

    lines: h, h2, site, in any number of rows.  A null site is no site; no lines give no rows.
    """
    rows = lines.where("site is not null")
    # partial sums before the shuffle: a line with fewer rows than `sites`, or on one site alone, needs no sketch
    seen = rows.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    often = seen.where((F.col("n") >= sites) & ((F.col("lo") != F.col("hi")) | (F.lit(sites) <= 1))).select("h", "h2", "n")
    pairs = rows.groupBy("h", "h2", "site").agg(F.count("*").alias("m"))
    few = common.written(pairs.join(often.hint("merge"), ["h", "h2"]).select("h", "h2", "site", "n"))
    spread = few.groupBy("h", "h2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2)).alias("sketch"), F.max("n").alias("n"))
    spread = common.written(spread.select("h", "h2", "n", F.hll_sketch_estimate("sketch").alias("estimate")))
    sure = spread.where(F.col("estimate") > sites * (1 + NEAR)).select("h", "h2", "n")
    near = spread.where(F.col("estimate").between(sites * (1 - NEAR), sites * (1 + NEAR))).select("h", "h2")
    exact = few.join(near.hint("merge"), ["h", "h2"]).groupBy("h", "h2").agg(F.countDistinct("site").alias("d"), F.max("n").alias("n")).where(F.col("d") >= sites).select("h", "h2", "n")
    return sure.union(exact)


def without_boilerplate(docs: DataFrame, sites: int = 10, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and _kept (the text without boilerplate lines), _lines and _removed (numbers of lines), which
    replace input columns of these names.

    Lines end at line feeds; lines without a word are never boilerplate and stay; the others are joined as they were.
    Null text: _kept null, no lines.  Empty text: one line without a word.  Rows with equal id and text count as one
    document for the cut, and each gets the result.  A line on exactly `sites` sites goes; a null site is no site, but
    its lines are cut like others.  A line is known by 96 bits of hashes.  An empty table gives no rows.  Further than NEAR from
    the threshold the sketch's estimate decides, which errs by so much about once in 10,000 lines (3.8 standard errors), and
    not at all where `sites` is small enough for sketches that count exactly.
    """
    # a row without an id has its text as its identity
    key = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.xxhash64(F.col(f"`{text_col}`"))]
    # texts are split and hashed once; the table of hashes serves all passes but the last
    lines = common.written(line_hashes(docs, text_col, k1=key[0], k2=key[1], site=F.col(f"`{site_col}`").cast("string")))
    bad = common.written(boilerplate(lines, sites))
    most = bad.agg(F.max("n")).first()[0] or 0
    salts = min(MOST_SALTS, max(1, -(-most // SALT_ROWS)))
    salted = bad.select("h", "h2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = lines.withColumn("salt", F.pmod(F.hash("k1", "k2"), F.lit(salts)))
    mark = "_gone"
    while any(c.startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    hits = rows.join(salted.hint("merge"), ["h", "h2", "salt"]).groupBy(F.col("k1").alias(f"{mark}1"), F.col("k2").alias(f"{mark}2")).agg(F.array_sort(F.collect_set("pos")).alias(mark))
    # a flag for each line up to the last that goes, from the gaps between those that go: looking one up takes no search
    gaps = F.transform(F.sequence(F.lit(0), F.size(mark) - 1), lambda k: F.concat(F.array_repeat(F.lit(False), F.get(mark, k) - F.when(k > 0, F.get(mark, k - 1) + 1).otherwise(0)), F.array(F.lit(True))))
    hits = hits.withColumn(f"{mark}3", F.flatten(gaps))
    text, gone = F.col(f"`{text_col}`"), F.col(mark)
    parts = F.split(text, "\n", -1)
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(parts, lambda line, i: ~F.coalesce(F.get(f"{mark}3", i), F.lit(False))), "\n"))
    joined = docs.join(hits, (key[0] == F.col(f"{mark}1")) & (key[1] == F.col(f"{mark}2")), "left")
    counts = [F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long"), F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")]
    return joined.select(*[f"`{c}`" for c in docs.columns if c not in RESULTS], *[e.alias(n) for e, n in zip((kept, *counts), RESULTS, strict=True)])


def line_report(docs: DataFrame, sites: int = 10, **names) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by line feeds; of nothing for a null text).

    As `without_boilerplate`: a row for each input row.
    """
    out = without_boilerplate(docs.select("doc_id", "text", "source"), sites, **names)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def report_sql(sites: int = 10) -> str:
    """The same report as SQL."""
    return f"""
    with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
    bad as (select line from l where source is not null and regexp_matches(line, '[^ \\t\\x0b\\x0c\\r]') group by line having count(distinct source) >= {sites}),
    d as (select doc_id, count(*) as n_lines, sum(case when line in (select line from bad) then 1 else 0 end) as n_removed,
          string_agg(case when line in (select line from bad) then null else line end, chr(10) order by pos) as kept from l group by doc_id)
    select t.doc_id, coalesce(d.n_lines, 0)::bigint as n_lines, coalesce(d.n_removed, 0)::bigint as n_removed, sha256(coalesce(d.kept, '')) as kept_sha256
    from documents t left join d on d.doc_id = t.doc_id"""
