"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: ASCII white space that separates words in every contract of this package.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set at sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares.

    The folder is spark.checkpoint.dir; only where a session in one process (as in tests) has none, a
    temporary one is set. A cluster without that setting is refused.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle and checkpoint files that nothing refers to any more.

    It does so when the driver's garbage is collected, which may be long after a checkpoint has made
    them useless.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside, as single rows may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not on this platform; memory is only kept longer


#: What this worker keeps between tasks.
_kept: dict = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What make gives, kept for later tasks of this worker; one thing at a time, as workers go from stage to stage."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Give back what this worker kept for another stage's tasks."""
    if _kept:
        _kept.clear()
        tidy()


def text_or_empty(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_fold(id_column: str, folds: int):
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, limit: int, id_column: str = "doc_id") -> DataFrame:
    """(id, text, label) of at most about `limit` labelled training rows, chosen by a hash of the id.

    The bound makes the selected label rows small enough to broadcast, so documents are never
    shuffled to find them. `train` is a condition on the label rows. Null labels and null ids are
    left out; where an id has several labels, the largest counts.
    """
    # Whatever other columns the documents have stays out of the join.
    docs = docs.select(F.col(id_column), text_or_empty().alias("text"))
    usable = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    usable = usable.where(train("_id"))
    total = usable.count()
    if total == 0:
        return docs.withColumn("y", F.lit(0)).where(F.lit(False))
    scale = 1 << 20
    share = min(scale, -(-limit * scale // total))
    picked = usable.where(F.pmod(F.xxhash64("_id"), F.lit(scale)) < share).groupBy("_id").agg(F.max("_y").alias("y"))
    return docs.join(F.broadcast(picked), F.col(id_column) == F.col("_id")).select(id_column, "text", "y")


class Membership:
    """A bounded bitmap of a key column, to spare rows a shuffle that a later join would drop.

    Sixteen bits a key up to 2**most_bits bits (4 MB by default). It passes every key it was made
    of and a share of others that only matters for speed; beyond the bound it passes more, never less.
    """

    def __init__(self, keys: DataFrame, column: str, most_bits: int = 25, hashed: bool = False):
        import numpy as np

        n = max(1, keys.count())
        self.slots = 1 << min(max((16 * n).bit_length(), 16), most_bits)
        # A column of hashes is its own slot, modulo their number.
        slot = F.pmod(F.col(column), F.lit(self.slots)) if hashed else self._slot(column)
        parts = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("w")).toArrow()
        words = np.zeros(self.slots >> 6, dtype=np.int64)
        words[parts["k"].to_numpy()] = parts["w"].to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(words)

    def _slot(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.slots))

    def flag(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """df with a column that says whether a row's key may be in the bitmap; a null key is not."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def maybe(slot):
            s = slot.to_numpy()
            return slot.__class__((shared.value[s >> 6] >> (s & 63)) & 1 == 1)

        return df.withColumn(out, F.col(column).isNotNull() & maybe(F.coalesce(self._slot(column), F.lit(0).cast("long"))))

    def sieve(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose key may be in the bitmap."""
        (maybe,) = fresh(df, "_maybe")
        return self.flag(df, column, maybe).where(F.col(maybe)).drop(maybe)
