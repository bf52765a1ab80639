"""Scans and sinks: CSV, JSON, logs, manifests, image headers, article texts; summaries, caches, partitioned tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import fin
from .heads import ImageHeads, read_files


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in whatever file system Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def finite_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[fin(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; an absent file is an empty table; NaN and infinities are NULL (SRC1)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return finite_doubles(spark.read.schema(schema).csv(path, header=True, nanValue="nan", positiveInf="inf", negativeInf="-inf", enforceSchema=True))


def parsed(files: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """Columns of the JSON object in each file; files without one are left out."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = files.select(F.from_json(F.col(column).cast("string"), schema + ", _corrupt_record string", how).alias("j")).where("j is not null")
    return rows.select("j.*")


def read_results(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """One JSON object for each file; unreadable files are skipped, only status `ok` stays (SRC2).

    With a schema, tasks list and read the files; without one Spark's reader finds it, and the driver lists them.
    """
    if schema:
        return parsed(read_files(spark, glob), schema).where("_corrupt_record is null and status = 'ok'").drop("_corrupt_record")
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(glob)
    if "_corrupt_record" in df.columns:
        df = df.where("_corrupt_record is null").drop("_corrupt_record")
    return df.where("status = 'ok'")


EXPERIMENT = """experiment string, model_variant string, main_k array<double>, region_k_windows array<array<double>>, recommended_sigma_adopted double,
recommended_annulus_scatter double, residual_regions map<string, struct<region string, n_use long, resid_median double, resid_mean double,
resid_std double, resid_p01 double, resid_p99 double, model_mean double, science_resid_name string, science_model_name string>>"""


def read_experiments(spark: SparkSession, glob: str) -> DataFrame:
    """Experiment metrics with one row for each residual region (SRC3)."""
    df = parsed(read_files(spark, glob), EXPERIMENT).drop("_corrupt_record")
    return df.select("*", F.explode_outer(F.map_entries("residual_regions")).alias("r")).select("*", F.col("r.key").alias("region_key"), F.col("r.value.*")).drop("r", "residual_regions")


#: What a worker log says and the name of the warning, in the order in which names are joined.
LOG_WARNINGS = [
    ("File may have been truncated", "truncated_file_warning"),
    ("No meaningful fit was possible", "isophote_real_only_failed"),
    ("fit may be unsuccessful", "sersic_fit_warning"),
]
#: The lines of a log that are read.
NUMBER = r"([+\-0-9.eE]+)"
LOG_DATASET = r"\[ISO\] fit dataset used = ([^,\n]+)"
LOG_EXTENSION = r"\[PSF\] selected extension = ([^\n]+)"
LOG_CORNERS = rf"\[BKG-CHECK\] corners: med={NUMBER}, mean={NUMBER}, std={NUMBER}, N=([0-9]+)"


def parse_logs(logs: DataFrame, galaxies: DataFrame, warnings: list[tuple[str, str]] = LOG_WARNINGS, key: str = "galaxy", text: str = "value") -> DataFrame:
    """One metadata row for each galaxy from its log: warnings, dataset, extension, corner statistics (SRC4).

    Dataset and extension are empty, corner statistics NULL, where the log doesn't say them or there is no log.
    """
    t = F.col(text)
    found = lambda pattern, k=1: F.nullif(F.regexp_extract(F.col(text), pattern, k), F.lit(""))
    rows = logs.select(
        key,
        F.lit(True).alias("log_exists"),
        F.concat_ws(";", *[F.when(t.contains(said), F.lit(name)) for said, name in warnings]).alias("warnings"),
        F.trim(found(LOG_DATASET)).alias("iso_dataset"),
        F.trim(found(LOG_EXTENSION)).alias("psf_extension"),
        *[found(LOG_CORNERS, k).try_cast("double").alias(f"bkg_check_{n}") for k, n in enumerate(("med", "mean", "std"), 1)],
        found(LOG_CORNERS, 4).try_cast("long").alias("bkg_check_n"),
    )
    out = galaxies.select(key).join(rows, key, "left")
    filled = {c: F.coalesce(c, F.lit("")) for c in ("iso_dataset", "psf_extension")}
    out = out.withColumns(filled | {"warnings": F.when(F.col("log_exists"), F.col("warnings")).otherwise("log missing")})
    return out.withColumn("log_exists", F.coalesce("log_exists", F.lit(False)))


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated manifest: blank lines, comments and lines without exactly four fields are skipped (SRC5)."""
    parts = F.split(F.col(column), "\t", -1)
    rows = lines.where((F.trim(column) != "") & ~F.ltrim(column).startswith("#") & (F.size(parts) == 4))
    return rows.select(*[F.trim(parts[k]).alias(n) for k, n in enumerate(("data_uri", "folder_tag", "category", "file_name"))])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def header_cards(content: DataFrame, blocks: int = 16, path: str = "path", data: str = "content") -> DataFrame:
    """80-byte cards of image headers: path, n, key, value, up to END; files that don't begin with SIMPLE have none (SRC6)."""
    head = F.decode(F.substring(F.col(data), 1, blocks * 2880), "ISO-8859-1")
    rows = content.select(path, head.alias("h")).where(F.substring("h", 1, 6) == "SIMPLE")
    cards = rows.select(path, F.posexplode(F.expr("transform(sequence(0, cast(floor(length(h) / 80) as int) - 1), i -> substring(h, i * 80 + 1, 80))")).alias("n", "card"))
    last = cards.where(F.rtrim("card") == "END").groupBy(path).agg(F.min("n").alias("last"))
    cards = cards.join(last, path).where("n < last")
    value = F.trim(F.regexp_extract("card", r"^.{8}=\s*('(?:[^']|'')*'|[^/]*)", 1))
    return cards.where(F.substring("card", 9, 1) == "=").select(path, "n", F.trim(F.substring("card", 1, 8)).alias("key"), F.trim(F.regexp_replace(value, "^'|'$", "")).alias("value"))


def read_header_cards(spark: SparkSession, glob: str) -> DataFrame:
    """Header cards of the image files that match, whatever their size: only their first blocks are read (SRC6)."""
    spark.dataSource.register(ImageHeads)
    return header_cards(spark.read.format(ImageHeads.name()).option("path", glob).load())


def target_coord(cards: DataFrame, path: str = "path") -> DataFrame:
    """Right ascension and declination of the target: TARG, else RA_TARG, else CRVAL (SRC6)."""
    pairs = [("TARG_RA", "TARG_DEC"), ("RA_TARG", "DEC_TARG"), ("CRVAL1", "CRVAL2")]
    keys = [k for p in pairs for k in p]
    wide = cards.where(F.col("key").isin(keys)).groupBy(path).agg(*[F.max(F.when(F.col("key") == k, F.col("value").try_cast("double"))).alias(k) for k in keys])
    both = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("ra"), F.col(b).alias("dec"), F.lit(a).alias("source"))) for a, b in pairs]
    return wide.select(path, F.coalesce(*both).alias("c")).select(path, "c.*")


def read_texts(spark: SparkSession, glob: str, labels: DataFrame | None = None) -> DataFrame:
    """Whole article texts with their labels: article, text, and what `labels` has by article (SRC7)."""
    texts = spark.read.text(glob, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("article"), F.col("value").alias("text"))
    return texts if labels is None else texts.join(labels, "article", "left")


def extract_values(texts: DataFrame, patterns: dict[str, str], column: str = "text") -> DataFrame:
    """A double for each pattern's first group, and `missing`: names of patterns that weren't found (SRC8)."""
    got = {n: F.regexp_extract(F.col(column), p, 1).try_cast("double") for n, p in patterns.items()}
    gone = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in got.items()]))
    return texts.withColumns(got).withColumn("missing", F.array_join(gone, ";"))


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in the order they are first seen, NULL where a frame has none (SNK1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_summary(frames: list[DataFrame], path: str) -> DataFrame:
    df = union_of_keys(frames)
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    return df


def upsert_cache(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace cached ones column by column where they have a value; sorted by the key (SNK2)."""
    rest = [c for c in cache.columns if c != key]
    a, b = cache.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest]).orderBy(key)


def write_table(df: DataFrame, path: str, parts: list[str], mode: str = "overwrite", rows: int = 4_000_000) -> None:
    """A partitioned Parquet table (SNK3): a file for about `rows` rows of each partition, so a large one has many tasks."""
    tasks = df.groupBy(*parts).agg(F.ceil(F.count("*") / rows).cast("int").alias("_tasks"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{p}`").eqNullSafe(F.col(f"_k{k}")) for k, p in enumerate(parts)])
    sized = df.join(tasks.withColumnsRenamed({p: f"_k{k}" for k, p in enumerate(parts)}), same)
    dealt = sized.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_tasks")))
    dealt.repartition(*[F.col(f"`{p}`") for p in parts], "_salt").select(*[f"`{c}`" for c in df.columns]).write.mode(mode).partitionBy(*parts).parquet(path)


def sorted_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in order of `keys`, NULLs last; `-name` sorts from the largest (TOP2)."""
    return df.orderBy(*[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys])


def null_if_blank(c: Column | str) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))
