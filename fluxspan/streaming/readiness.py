"""Input readiness and latest status as streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.storage import discard, written

READY = "target string, ready boolean, reason string, at timestamp"
#: Targets lie in groups of state by their hash; a group's targets are read and written at once
#: (some 7,000 of them at 360 x sf0.1).
GROUPS = 1 << 11


class Readiness:
    """What is known of the targets of one group: of each its first and last poll, whether it has been reported, its bands, and
    the polls that the watermark hasn't passed.

    A poll counts when the watermark passes its time, so polls count in order of their times however they arrive.
    """

    def __init__(self, timeout_s: int, share: float, bands: int):
        self.timeout, self.share, self.n_bands = timeout_s * 1_000_000, share, bands

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        targets = {t: (wake, known) for t, wake, known in json.loads(state.get[0])} if state.exists else {}
        due = {t for t, (wake, _) in targets.items() if wake <= now}
        for f in () if state.hasTimedOut else frames:
            columns = [f[c].tolist() for c in ("target", "band", "size", "expected", "unknown", "readable", "at")]
            for target, band, size, expected, unknown, readable, at in zip(*columns, strict=True):
                due.add(target)
                known = targets[target][1] if target in targets else [at, at, False, [], []]
                known[0], known[1] = min(known[0], at), max(known[1], at)
                if not known[2]:
                    known[4].append((band, size, None if unknown else expected, readable, at))
                targets[target] = (now, known)
        rows = []
        for t in due:
            wake, known = self._settled(t, targets[t][1], now, rows)
            if known:
                targets[t] = (wake, known)
            else:
                del targets[t]
        if targets:
            state.update((json.dumps([(t, wake, known) for t, (wake, known) in targets.items()]),))
            # a timeout fires once the watermark is above it
            state.setTimeoutTimestamp(max(1, -(-min(wake for wake, _ in targets.values()) // 1000) - 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["target", "ready", "reason", "at"])

    def _settled(self, target: str, known: list, now: int, rows: list) -> tuple[int, list | None]:
        """Counts the polls that the watermark has passed and reports; when to look again, and what is left to know."""
        first, last, done, bands, waiting = known
        while not done:
            end = first + self.timeout
            waiting = sorted(waiting, key=lambda p: (p[4], p[0] or ""))
            seen = {b: (size, same, ok) for b, size, same, ok in bands}
            passed = [p for p in waiting if p[4] <= now and p[4] <= end]
            ready = next((p[4] for p in passed if self._counted(seen, p)), None)
            if ready is not None:
                rows.append((target, True, "all bands", ready))
                done, bands, waiting = True, [], []
                break
            waiting = waiting[len(passed) :]
            if end > now:
                return min([end, *(p[4] for p in waiting[:1])]), [first, last, False, [(b, *v) for b, v in seen.items()], waiting]
            rows.append((target, False, "timeout", end))
            if not waiting:
                return end, None
            first, last, bands = waiting[0][4], waiting[-1][4], []  # begins anew
        silent = last + self.timeout
        return silent, None if silent <= now else [first, last, done, bands, waiting]

    def _counted(self, bands: dict, poll: tuple) -> bool:
        """Takes one poll into account; whether all bands have arrived."""
        band, size, expected, readable, _ = poll
        old_size, same, ok = bands.get(band, (-1, 0, False))
        same = same + 1 if size >= 0 and size == old_size else 0
        whole = same >= 2 if expected is None else size == expected or size >= int(self.share * expected)
        bands[band] = (size, same, bool(ok or whole and readable and size >= 0))
        return sum(1 for v in bands.values() if v[2]) >= self.n_bands


def ready_stream(events: DataFrame, timeout_s: int = 3600, share: float = 0.995, bands: int = 2, groups: int = GROUPS) -> DataFrame:
    """Targets whose bands have all arrived (STR1), on event time.

    events: target, band, size, expected, readable, ts, with a watermark on ts.  A band has arrived when it is readable with its
    expected size, or at least 99.5 % of it, or, without an expected size, unchanged in two polls after each other; it stays
    arrived.  Polls count in the order of their times once the watermark has passed them; later ones are dropped, as are
    those without a time.  A target is reported once, with the time of the deciding poll; one that isn't ready within the
    timeout after its first poll is reported as not ready, and begins anew with later polls.  A reported target stays silent;
    its state goes when it has had no poll for the timeout.

    A call into Python costs far more than a target, so a call settles the targets of one of `groups` groups.  A checkpoint
    keeps the number it was begun with; state of older versions, one for each target, is not read.
    """
    group = F.pmod(F.xxhash64("target"), F.lit(groups)).cast("int")
    polls = events.where("ts is not null").select(group.alias("group"), "target", "band", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("expected", F.lit(0)).alias("expected"), F.isnull("expected").alias("unknown"), F.coalesce("readable", F.lit(False)).alias("readable"), F.unix_micros("ts").alias("at"), "ts")
    out = polls.groupBy("group").applyInPandasWithState(Readiness(timeout_s, share, bands), "target string, ready boolean, reason string, at long", "targets string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("at", F.timestamp_micros("at"))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Runs a stream over all input that is there, with a last batch that lets timers fire, and ends."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        stream = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    stream.awaitTermination()


def latest_status(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """The newest status of each key; of equal times the larger (STR2)."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias(time))


#: Buckets of a status table, by the hash of the key.
BUCKETS = 64
#: Manifests, and what they name, that stay when a new one comes: readers may still be on the last one.
KEPT = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def _read_manifest(spark: SparkSession, path: str, number: int) -> dict:
    _, p = _fs(spark, f"{path}/manifest/{number}")
    return json.loads("\n".join(r.value for r in spark.read.text(p.toString()).collect()))


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """The manifest appears whole, by a rename, or not at all."""
    fs, draft = _fs(spark, f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{path}/manifest/{number}")[1]):
        fs.delete(draft, False)


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], time: str, value: str, buckets: int = BUCKETS) -> None:
    """Merges one batch into the status table at `path` (STR2).

    Keys lie in buckets by their hash.  Only the buckets that the batch touches are read and written, each as a new version
    beside the old one; then a manifest that names the version of every bucket replaces the last.  A batch that a manifest
    already names is skipped, so replaying it changes nothing; a failed one leaves the table as it was.
    """
    spark = batch.sparkSession
    known = _manifests(spark, path)
    last = _read_manifest(spark, path, known[-1]) if known else {"batch": -1, "buckets": {}}
    if number <= last["batch"]:
        return
    new = latest_status(batch.select(*keys, time, value), keys, time, value).select(*keys, time, value)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = written(new.withColumn("bucket", bucket))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
    paths = [f"{path}/{last['buckets'][str(b)]}" for b in touched if str(b) in last["buckets"]]
    rows = new.drop("bucket")
    if paths:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*paths))
    version = f"data/{number}-{uuid.uuid4().hex}"
    merged = latest_status(rows, keys, time, value).select(*keys, time, value).withColumn("bucket", bucket)
    if touched:
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{version}")
    discard(new)
    now = last["buckets"] | {str(b): f"{version}/bucket={b}" for b in touched}
    _commit(spark, path, number, {"batch": number, "buckets": now, "schema": rows.schema.json()})
    _compact(spark, path)


def _compact(spark: SparkSession, path: str) -> None:
    """Deletes bucket versions that none of the newest manifests names, and older manifests."""
    known = _manifests(spark, path)
    named = {b for n in known[-KEPT:] for b in _read_manifest(spark, path, n)["buckets"].values()}
    fs, data = _fs(spark, f"{path}/data")
    for v in fs.listStatus(data) if fs.exists(data) else []:
        parts = [f.getPath() for f in fs.listStatus(v.getPath()) if f.getPath().getName().startswith("bucket=")]
        own = {p.getName(): p for p in parts}
        gone = [n for n in own if f"data/{v.getPath().getName()}/{n}" not in named]
        if len(gone) == len(own):
            fs.delete(v.getPath(), True)
        else:
            for n in gone:
                fs.delete(own[n], True)
    for n in known[:-KEPT]:
        fs.delete(_fs(spark, f"{path}/manifest/{n}")[1], False)


def merge_status(stream: DataFrame, path: str, keys: list[str], time: str, value: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Stream into a table of the newest status of each key, one `merge_batch` for each micro-batch (STR2)."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, keys, time, value, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The table that `merge_status` keeps, as its newest manifest names it (STR2)."""
    manifest = _read_manifest(spark, path, _manifests(spark, path)[-1])
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    paths = [f"{path}/{b}" for b in manifest["buckets"].values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def still_to_do(work: DataFrame, status: DataFrame, keys: list[str], value: str = "status", done: str = "ok") -> DataFrame:
    """Keys without a completed result (STR2)."""
    return work.join(status.where(F.col(value) == done), keys, "left_anti")
