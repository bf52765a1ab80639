"""Domain views over the test tables, as DataFrames and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is a row of 64 pixels; vectors of one label, in order of their ids, are an image."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("image_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"), "embedding")
    return v.select("image_id", "y", F.posexplode("embedding").alias("x", "v")).select("image_id", "y", "x", F.col("v").cast("double").alias("value"))


def pixels_big(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 256 x 256 cells: mean price by order and part."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("image_id"), (F.col("l_orderkey") % 256).cast("int").alias("y"), (F.col("l_partkey") % 256).cast("int").alias("x")).agg(F.avg("l_extendedprice").alias("value"))


def measurements(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    return li.groupBy(F.col("l_suppkey").alias("galaxy"), F.when(F.col("l_returnflag") == "A", "inner").otherwise("outer").alias("region"), F.col("l_linenumber").alias("wnd")).agg(F.avg(F.log10("l_extendedprice")).alias("mbar"), F.avg(0.05 + F.col("l_discount")).alias("sigma"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(F.col("p_brand").alias("g"), "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e4).alias("y"), (0.1 + F.col("l_tax")).alias("sigma"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean of event values by type, days numbered from the first."""
    e = events(spark, d).groupBy("event_type", F.expr("cast(date_trunc('day', ts) as date)").alias("day")).agg((F.avg("value") - 50).alias("v"))
    return e.select("event_type", F.datediff("day", F.lit("1990-01-01").cast("date")).cast("double").alias("x"), F.col("v").alias("y"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of regions (nations) and galaxies (regions): magnitudes from account balances."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("galaxy"), F.col("c_nationkey").alias("region"), F.col("c_custkey").alias("label"), (20 + F.col("c_acctbal") / 2000).alias("mag_ab"), F.col("c_acctbal").alias("flux_adopted"))


PIXELS = """r_ as (select label as image_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) as y, embedding from embeddings),
pixels as (select image_id, y, cast(unnest(range(0, 64)) as int) as x, cast(unnest(embedding) as double) as value from r_)"""
PIXELS_BIG = """big as (select l_returnflag || l_linestatus as image_id, cast(l_orderkey % 256 as int) as y, cast(l_partkey % 256 as int) as x, avg(l_extendedprice) as value from lineitem group by all)"""
MEASUREMENTS = """meas as (select l_suppkey as galaxy, case when l_returnflag = 'A' then 'inner' else 'outer' end as region, l_linenumber as wnd, avg(log10(l_extendedprice)) as mbar, avg(0.05 + l_discount) as sigma
from lineitem where l_returnflag in ('A', 'R') group by all)"""
CALIBRATION = """cal as (select p_brand as g, l_orderkey, l_linenumber, l_quantity / 50 as x, l_extendedprice / 1e4 as y, 0.1 + l_tax as sigma from lineitem join part on l_partkey = p_partkey)"""
PROFILE = """profile as (select event_type, cast(date_diff('day', date '1990-01-01', cast(date_trunc('day', ts) as date)) as double) as x, avg(value) - 50 as y from events group by all)"""
SOURCES = """sources as (select n_regionkey as galaxy, c_nationkey as region, c_custkey as label, 20 + c_acctbal / 2000 as mag_ab, c_acctbal as flux_adopted from customer join nation on c_nationkey = n_nationkey)"""
CENTERS = "centers as (select image_id, (max(x) - min(x)) / 2.0 as cx, (max(y) - min(y)) / 2.0 as cy from pixels group by image_id)"


def centers(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(((F.max("x") - F.min("x")) / 2.0).alias("cx"), ((F.max("y") - F.min("y")) / 2.0).alias("cy"))
