"""What the operators of this package share: the shared folder, staged tables, words and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import ship

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256
#: Entries after which a worker's word cache is emptied; bounds its memory.
CACHE_WORDS = 250_000
#: Tasks that read written files at most; beyond them a task reads several files one after another.
READERS = 20_000
#: Rows up to which a table of ids may be broadcast (16 bytes a row: about 32 MB); beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one is made if all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if "://" in folder else "file://" + folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tokenloom/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Deletes the folders of staged frames that no later plan reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URL and the path in it, on the driver or in a worker."""
    return pafs.FileSystem.from_uri(url)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array):
    """The texts of an Arrow column, slice by slice, so that only few are Python objects at a time."""
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(column: pa.Array, apply, kind: pa.DataType) -> pa.Array:
    """apply(list of Python objects) over an Arrow column, a slice of SLICE_ROWS at a time."""
    parts = [pa.array(apply(column.slice(at, SLICE_ROWS).to_pylist()), kind) for at in range(0, len(column), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def keep_rows(measured: DataFrame, name: str, accepts) -> DataFrame:
    """The rows of measured that accepts(list of measures) marks, without the column of measures.

    Only that column goes to Python and one mark a row comes back; the rows themselves stay in the JVM.
    """
    mark = F.arrow_udf(lambda column: sliced(column, lambda some: [bool(x) for x in accepts(some)], pa.bool_()), "boolean")
    return measured.where(mark(F.col(name))).drop(name)


#: Tasks that add up the sums of partitions, so that few reach the driver.
SUMMING = 8


def summed(rows: DataFrame, batch_sum, size: int) -> np.ndarray:
    """The sum of batch_sum(batch), vectors of `size` numbers, over all Arrow batches; one vector a partition is shuffled."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += batch_sum(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def added(batches):
        total = np.zeros(size)
        for batch in batches:
            for own in batch.column("total"):
                total += np.frombuffer(own.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    found = rows.mapInArrow(run, "total binary")
    if rows.rdd.getNumPartitions() > SUMMING:
        found = found.repartition(SUMMING).mapInArrow(added, "total binary")
    return sum((np.frombuffer(r["total"]) for r in found.collect()), np.zeros(size))


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8 bytes: bytes.split() parts at exactly those six characters."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """Word -> 64-bit hash, kept up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = byte_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out * _M3 + h[i : i + n])
    return np.unique(out)


#: Ranges that a table is cut into at most, and ids of the sample that cuts them, for each range.
MOST_RANGES, SAMPLED = 10_000, 64


def id_cuts(ids: DataFrame, rows: int, ranges: int) -> np.ndarray:
    """Values that cut ids(id) of a table of so many rows into about equal ranges, the same for the same rows.

    The ids are taken by their hash, so neither the order of the rows nor their partitions matter; some SAMPLED
    for each range come to the driver, with how often they occur.
    """
    ranges = min(MOST_RANGES, ranges)
    if ranges < 2:
        return np.empty(0, np.int64)
    every = max(1, rows // (ranges * SAMPLED))
    found = ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).groupBy("id").agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(found["id"].to_numpy())
    values, upto = found["id"].to_numpy()[order], np.cumsum(found["n"].to_numpy()[order])
    if not len(values):
        return np.empty(0, np.int64)
    return np.unique(values[np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges), len(values) - 1)])


def range_of(cuts: np.ndarray):
    """A function of an id: the number of its range, 0 for null."""

    @F.arrow_udf("int")
    def place(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, column.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(known, at, 0), pa.int32())

    return place
