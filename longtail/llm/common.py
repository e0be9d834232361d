"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import builtins
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import folder as shared_dir

#: ASCII white space as the word patterns of this package see it; bytes.split() cuts at exactly these.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


#: Spark's own bounds of an Arrow batch, and those that hold where a session has them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches where the session has Spark's own bounds: a batch is held in memory several times, on both sides."""
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes the ones no later step reads."""

    def __init__(self, spark: SparkSession):
        lean(spark)
        self.spark, self.root, self.n = spark, shared_dir(spark), 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._longtail_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._longtail_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; larger tables are left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def once(key: str, make: Callable):
    """make(), kept for the life of this Python worker."""
    kept = builtins.__dict__.setdefault("_longtail_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def sent(spark: SparkSession, value) -> Callable:
    """A broadcast of value, as a function that gives it on an executor, which need not have this package: classes go by value."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    number = data._jbroadcast.id()

    def get():
        kept = builtins.__dict__.setdefault("_longtail_sent", {})
        if number not in kept:
            while len(kept) > 1:  # a worker serves few steps at a time
                kept.pop(next(iter(kept)))
            kept[number] = pickle.loads(data.value)
        return kept[number]

    return get


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, list]]:
    """A string or binary column as (first row, values) of about `most` bytes each, so that a batch is never held twice."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        held += n
        if held >= most or i + 1 == len(size):
            yield first, column.slice(first, i + 1 - first).to_pylist()
            first, held = i + 1, 0


def word_bytes(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, as UTF-8."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()
