"""Streams: readiness on event time, the newest status as a keyed table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fluxspan.streaming import readiness

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "target string, band string, size long, expected long, readable boolean, ts timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, timeout_min=60, delay="10 minutes"):
    """Each batch is a file that the stream takes on its own."""
    src = tmp_path / "in"
    out = []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(t, b, s, e, r, at(m)) for t, b, s, e, r, m in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = readiness.ready_stream(spark.readStream.schema(SCHEMA).parquet(str(src)).withWatermark("ts", delay), timeout_min * 60)
        readiness.run_to_end(spark, stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append"))
        got = spark.read.schema(readiness.READY).parquet(str(tmp_path / "out"))
        out.append(sorted((r.target, r.ready, r.reason, int((r.at - T0).total_seconds() // 60)) for r in got.collect()))
    return out


def test_out_of_order_and_late(spark, tmp_path):
    tick = [("clock", "a", 1, 9, False, 30)]
    out = run(spark, tmp_path, [
        # b's sizes 5, 5, 5 come out of order with a 7 first: only the order of times makes the last three equal
        [("A", "a", 100, 100, True, 1), ("A", "b", 5, None, True, 9), ("A", "b", 7, None, True, 3), ("A", "b", 5, None, True, 6)],
        [("A", "b", 5, None, True, 4), *tick],
        # behind the watermark of minute 20: dropped
        [("B", "a", 10, 10, True, 2), ("clock", "a", 1, 9, False, 31)],
        [("B", "b", 10, 10, True, 35), ("clock", "a", 1, 9, False, 50)],
    ])
    assert out[0] == [] and out[1] == out[2] == out[3] == [("A", True, "all bands", 9)]


def test_timeout_fires_and_finished_targets_stay_silent(spark, tmp_path):
    clock = lambda m: ("clock", "z", 1, 9, False, m)
    out = run(spark, tmp_path, [
        [("A", "a", 10, 10, True, 0), ("A", "b", 996, 1000, True, 1), ("B", "a", 10, 10, True, 0), ("B", "b", 994, 1000, True, 1), ("C", "a", 10, 10, False, 2), ("C", "b", 10, 10, True, 2)],
        [clock(40), ("A", "a", 10, 10, True, 40), ("A", "b", 1000, 1000, True, 41)],  # A is reported; it is polled again
        [clock(85)],  # B and C have waited for over an hour
        [clock(200), ("B", "a", 10, 10, True, 90), ("B", "b", 1000, 1000, True, 91)],  # B begins anew
        [clock(400)],
    ])
    done = [("A", True, "all bands", 1)]
    assert out[0] == [] and out[1] == done
    assert [r for r in out[2] if r[0] != "clock"] == [*done, ("B", False, "timeout", 60), ("C", False, "timeout", 62)]
    assert [r for r in out[4] if r[0] != "clock"] == [*done, ("B", False, "timeout", 60), ("B", True, "all bands", 91), ("C", False, "timeout", 62)]


ROW = "k long, t long, v string"


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


def test_status_table_rewrites_touched_buckets_only(spark, tmp_path):
    table, path = tmp_path / "table", f"file://{tmp_path}/table"
    merge = lambda rows, n: readiness.merge_batch(spark.createDataFrame(rows, ROW), n, path, ["k"], "t", "v", buckets=16)
    merge([(k, 1, "new") for k in range(2000)] + [(5, 3, "late"), (5, 2, "mid")], 0)
    first = files_of(table)
    merge([(5, 4, "ok"), (7, 0, "old")], 1)
    second = files_of(table)
    added = set(second) - set(first)
    assert 1 <= len(added) <= 2 and sum(second[f] for f in added) < sum(first.values()) / 4
    state = {r.k: (r.t, r.v) for r in readiness.read_status(spark, path).collect()}
    assert len(state) == 2000 and state[5] == (4, "ok") and state[7] == (1, "new")
    merge([(5, 9, "twice")], 1)  # a replayed batch changes nothing
    assert files_of(table) == second and {r.k: (r.t, r.v) for r in readiness.read_status(spark, path).collect()} == state
    for n in range(2, 7):
        merge([(5, 10 + n, f"s{n}")], n)
    assert len(files_of(table)) <= len(first) + 2  # older versions are gone
    assert len(list((table / "manifest").glob("[0-9]*"))) == readiness.KEPT
    got = readiness.read_status(spark, path)
    assert got.count() == 2000 and got.where("k = 5").first().v == "s6"
    merge([], 7)
    assert readiness.read_status(spark, path).count() == 2000


def test_failed_batch_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    merge = lambda rows, n: readiness.merge_batch(spark.createDataFrame(rows, ROW), n, path, ["k"], "t", "v", buckets=4)
    merge([(k, 1, "a") for k in range(20)], 0)
    with monkeypatch.context() as m:
        m.setattr(readiness, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge([(k, 2, "b") for k in range(20)], 1)
    assert {r.v for r in readiness.read_status(spark, path).collect()} == {"a"}
    merge([(k, 2, "b") for k in range(20)], 1)
    assert {r.v for r in readiness.read_status(spark, path).collect()} == {"b"}


def test_status_stream(spark, tmp_path):
    src, path = tmp_path / "in", f"file://{tmp_path}/table"
    for n in range(3):
        spark.range(50).select((F.col("id") % (10 * (n + 1))).alias("k"), (F.col("id") + 100 * n).alias("t"), F.lit(f"b{n}").alias("v")).coalesce(1).write.mode("append").parquet(str(src))
        readiness.run_to_end(spark, readiness.merge_status(spark.readStream.schema(ROW).parquet(str(src)), path, ["k"], "t", "v", str(tmp_path / "state"), 8))
    got = readiness.read_status(spark, path)
    assert got.count() == 30 and {r.v for r in got.collect()} == {"b2"}


def brute(polls, timeout, mark):
    """Reports of one target whose polls (minute, band, size, expected, readable) are all there, up to the watermark."""
    out, first, bands = [], None, {}
    for m, band, size, expected, readable in sorted(polls, key=lambda p: p[:2]):
        if m > mark:
            break
        if first is not None and m > first + timeout:
            out.append((False, "timeout", first + timeout))
            first, bands = None, {}
        first = m if first is None else first
        old, same, ok = bands.get(band, (-1, 0, False))
        same = same + 1 if size == old else 0
        bands[band] = (size, same, ok or readable and (same >= 2 if expected is None else size >= int(0.995 * expected)))
        if sum(v[2] for v in bands.values()) >= 2:
            return [*out, (True, "all bands", m)]  # and silent: no poll is an hour after the one before
    if first is not None and first + timeout <= mark:
        out.append((False, "timeout", first + timeout))
    return out


def test_many_targets_share_few_groups_of_state(spark, tmp_path):
    rng = random.Random(7)
    polls = {f"T{k}": [(m, rng.choice("ab"), rng.choice((5, 10)), rng.choice((None, 10)), rng.random() < 0.7) for m in rng.sample(range(0, 200), 8)] for k in range(400)}
    polls = {t: p for t, p in polls.items() if all(b - a < 60 for a, b in zip(sorted(m for m, *_ in p), sorted(m for m, *_ in p)[1:], strict=False))}
    assert len(polls) > 100
    src, states = tmp_path / "in", []
    for lo, hi in ((0, 70), (70, 140), (140, 200)):
        rows = [(t, b, s, e, r, at(m)) for t, ps in polls.items() for m, b, s, e, r in ps if lo <= m < hi]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = readiness.ready_stream(spark.readStream.schema(SCHEMA).parquet(str(src)).withWatermark("ts", "10 minutes"), 3600, groups=3)
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
        run = writer.trigger(availableNow=True).start()
        run.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress))
    mark = max(m for ps in polls.values() for m, *_ in ps) - 10
    got = sorted((r.target, r.ready, r.reason, int((r.at - T0).total_seconds() // 60)) for r in spark.read.schema(readiness.READY).parquet(str(tmp_path / "out")).collect())
    assert got == sorted((t, *r) for t, ps in polls.items() for r in brute(ps, 60, mark))
    assert {r[1] for r in got} == {True, False}
    assert max(states) <= 3  # not one for each target
