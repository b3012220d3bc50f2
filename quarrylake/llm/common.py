"""What the corpus operators share: table access, shared scratch tables, text batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any store that Spark's reader opens will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session has none and runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quarrylake-")
    return "file://" + _LOCAL[app]


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame) -> None:
    """Deletes the files of a scratch table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch of Python lists or numpy arrays in the order of schema."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def id_text_rows(batches: Iterator[pa.RecordBatch], chunk: int = 512) -> Iterator[tuple[list, list]]:
    """(ids, texts) of small slices of two-column batches, so that few decoded texts are alive at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def give_back() -> None:
    """Memory that this process has freed goes back to the machine (where its C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; a Python worker lives on from stage to stage, so a task's end gives its memory back."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow, likewise at the end of a group; for groups of the size of a task."""

    @functools.wraps(run)
    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return whole


def most_frequent(df: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows of greatest n, limit at most: whole classes of n (a quarter of a power of two wide), so that a histogram of a few hundred rows finds the cut and no task sends its own top rows to the driver. df is read twice."""
    level = F.floor(F.log2(F.col(n)) * 4).cast("int")
    cut, total = None, 0
    for r in df.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > limit:
            break
        cut = r["level"]
    return df.where(level >= cut) if cut is not None else df.limit(0)


class BoundedBloom:
    """A Bloom filter of at most 2**MOST bits, whatever it is made from: what it lets through is checked again later.

    Its words are built by a grouped aggregate, so at most 2**(MOST - 6) rows reach the driver.
    """

    LEAST, MOST, PER_KEY, PROBES = 16, 25, 12, 3

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> BoundedBloom:
        """From a table with a binary or long column; it is read twice."""
        n = df.count()
        bits = min(cls.MOST, max(cls.LEAST, (n * cls.PER_KEY).bit_length()))
        key = F.col(column) if dict(df.dtypes)[column] == "binary" else F.unhex(F.lpad(F.hex(column), 16, "0"))
        text = F.hex(key)
        place = lambda k: F.conv(F.substring(text, 1 + 5 * k, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
        spread = df.select(F.explode(F.array(*[place(k) for k in cls._offsets(column, df)])).alias("bit"))
        found = spread.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toPandas()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
        return cls(words)

    @classmethod
    def _offsets(cls, column: str, df: DataFrame) -> range:
        return range(cls.PROBES if dict(df.dtypes)[column] == "binary" else 2)

    def has(self, key: bytes) -> bool:
        """Of a 16-byte key: 32 bits each from hex digits 0, 5 and 10."""
        digits = key.hex()
        mask = int(self.mask)
        for k in range(self.PROBES):
            bit = int(digits[5 * k : 5 * k + 8], 16) & mask
            if not int(self.words[bit >> 6]) >> (bit & 63) & 1:
                return False
        return True

    def has_longs(self, keys: np.ndarray) -> np.ndarray:
        """Of 64-bit keys, as unsigned numbers."""
        ok = np.ones(len(keys), bool)
        for k in range(2):
            bit = (keys >> np.uint64(32 - 20 * k)) & np.uint64(0xFFFFFFFF) & self.mask
            ok &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok
