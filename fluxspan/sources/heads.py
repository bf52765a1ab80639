"""A data source for the first blocks of image files: files are its partitions, and each is read block by block up to END.

Also many small files, which tasks list, read and write: the driver knows their folders only.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a header block, and of a card.
BLOCK, CARD = 2880, 80
#: Files of one partition.
FILES = 64


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def matching(glob: str) -> list[str]:
    """Files that match a pattern with `*` in any part but the first, sorted; the path itself if it has none."""
    if "*" not in glob:
        return [glob]
    base = glob.partition("*")[0].rpartition("/")[0]
    rest = glob[len(base) + 1 :]
    fs, inside = opened(base)
    found = fs.get_file_info(pafs.FileSelector(inside, recursive="/" in rest, allow_not_found=True))
    names = [f.path[len(inside.rstrip("/")) + 1 :] for f in found if f.type == pafs.FileType.File]
    return sorted(f"{base}/{n}" for n in names if n.count("/") == rest.count("/") and fnmatchcase(n, rest))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.glob, self.blocks = options["path"], int(options.get("blocks", 16))

    def partitions(self) -> list[Files]:
        paths = matching(self.glob)
        return [Files(paths[k : k + FILES]) for k in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            fs, inside = opened(path)
            head = b""
            size = fs.get_file_info(inside).size
            with fs.open_input_stream(inside) if path.endswith(".gz") else fs.open_input_file(inside) as f:
                while len(head) < self.blocks * BLOCK:
                    block = f.read(BLOCK)
                    head += block
                    ends = any(block[k : k + CARD].rstrip() == b"END" for k in range(0, len(block), CARD))
                    if len(block) < BLOCK or ends or not head.startswith(b"SIMPLE"):
                        break
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([head], pa.binary()), pa.array([len(head)], pa.int32())], ["path", "length", "content", "bytes_read"])


class ImageHeads(DataSource):
    """path, length (of the file), content (its first blocks, up to END), bytes_read.  Options: path (a pattern), blocks.

    Files named `.gz` are unpacked as far as they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "image_heads"

    def schema(self) -> str:
        return "path string, length long, content binary, bytes_read int"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def write_images(files: DataFrame, folder: str, size: Column) -> None:
    """A file for each row: name, head; zeros follow up to `size` bytes.  Files named `.gz` are packed."""

    def work(batches):
        for b in batches:
            fs, base = opened(folder)
            fs.create_dir(base, recursive=True)
            for name, head, n in zip(*[b.column(c).to_pylist() for c in ("name", "head", "size")], strict=True):
                with fs.open_output_stream(f"{base}/{name}") as f:
                    f.write(head)
                    f.write(bytes(max(n - len(head), 0)))
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    rows = files.select("name", "head", size.cast("long").alias("size"))
    rows.repartition(_tasks(files.sparkSession), "name").mapInArrow(work, "name string").count()


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


#: Small files of one folder, about.
SMALL = 4_000


def write_files(files: DataFrame, folder: str) -> None:
    """A file for each row: name, body.  Files lie in subfolders by the hash of their names."""
    folders = max(_tasks(files.sparkSession), files.count() // SMALL)

    def work(batches):
        made = set()
        for b in batches:
            fs, base = opened(folder)
            for name, body, at in zip(*[b.column(c).to_pylist() for c in ("name", "body", "at")], strict=True):
                if at not in made:
                    fs.create_dir(f"{base}/{at}", recursive=True)
                    made.add(at)
                with fs.open_output_stream(f"{base}/{at}/{name}") as f:
                    f.write(body)
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    at = F.pmod(F.xxhash64("name"), F.lit(folders))
    rows = files.select("name", F.col("body").cast("binary").alias("body"), at.alias("at"))
    rows.repartition(folders, "at").mapInArrow(work, "name string").count()


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, content (binary) of whole small files that match, or lie in a folder that does.

    The driver lists folders; tasks list what is in them and read it.  What pyarrow's file systems can't open, Spark reads.
    """
    parent, _, name = glob.rstrip("/").rpartition("/")
    try:
        opened(parent)
    except (pa.ArrowInvalid, NotImplementedError):
        return spark.read.format("binaryFile").load(glob).select("path", "content")
    if set("{\\") & set(name):
        raise ValueError(f"names are matched by * ? [] only: {name}")
    found = lambda p: (lambda h: h.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(h) or [])(spark._jvm.org.apache.hadoop.fs.Path(p))
    where = [(f.getPath().toString(), name) for f in found(parent) if f.isDirectory()]
    if not where:
        return spark.createDataFrame([], "path string, content binary")

    def names(batches):
        for b in batches:
            for folder, pattern in zip(b.column("folder").to_pylist(), b.column("pattern").to_pylist(), strict=True):
                fs, base = opened(folder)
                entries = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name[0] not in "._" and fnmatchcase(f.base_name, pattern)]
                here = sorted(f"{folder}/{f.base_name}" for f in entries if f.type == pafs.FileType.File)
                for sub in (f.base_name for f in entries if f.type == pafs.FileType.Directory):
                    below = [f for f in fs.get_file_info(pafs.FileSelector(f"{base}/{sub}")) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
                    here += sorted(f"{folder}/{sub}/{f.base_name}" for f in below)
                for lo in range(0, len(here), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(here[lo : lo + 10_000], pa.string())], ["path"])

    def contents(batches):
        for b in batches:
            out, size = [], 0
            for path in b.column("path").to_pylist():
                fs, base = opened(path)
                with fs.open_input_file(base) as f:
                    out.append((path, f.read()))
                size += len(out[-1][1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.binary()))], ["path", "content"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.binary()))], ["path", "content"])

    tasks = _tasks(spark)
    folders = spark.createDataFrame(where, "folder string, pattern string").repartition(min(tasks, len(where)))
    return folders.mapInArrow(names, "path string").repartition(tasks).mapInArrow(contents, "path string, content binary")
