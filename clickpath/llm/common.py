"""Pieces that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but blank, tab and line ends (ASCII).
WORD = r"[^\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for frame in frames:
        files = frame.inputFiles()
        if files:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chain64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b) of 64-bit hashes; order matters."""
    with np.errstate(over="ignore"):
        return mix64(a * _GOLDEN + b + np.uint64(0x632BE59BD9B4E019))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n]
    for k in range(1, size):
        out = chain64(out, words[k:k + n])
    return out


def widened(batch: pa.RecordBatch, keep: list[str], new: dict[str, list | pa.Array]) -> pa.RecordBatch:
    """The kept columns of an Arrow batch, as they are, and new ones beside them."""
    columns = {name: batch.column(name) for name in keep}
    return pa.RecordBatch.from_pydict(columns | new)


def ddl(df: DataFrame, columns: list[str]) -> str:
    """The columns as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
