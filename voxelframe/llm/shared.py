"""What the operators share: words, fingerprints, written tables, size checks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder serves a local session; a cluster's executors could not read it, so there it is an error."""
    if not (root := spark.conf.get("spark.checkpoint.dir", "")):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets go of the shuffled files of finished jobs
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that `stored` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound; a plain (shuffled) side beyond it."""
    return F.broadcast(df) if rows <= most else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


class WordHash(dict):
    """64-bit fingerprints of words (bytes). The memo of frequent words is bounded; the rest is computed each time."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct fingerprints of k consecutive words; of the whole sequence where it is shorter; empty without words."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    k, m = min(k, n), max(1, n - k + 1)
    out = np.full(m, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix64(out * GOLDEN + h[j : j + m])
    return np.unique(out)
