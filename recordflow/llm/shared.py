"""What the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset in local mode (tests) a temporary folder is made, set and removed
    at exit; on a cluster that is an error, as no folder of the driver's is shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="recordflow-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables that were settled and not removed yet.
_made: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends
    there, and a lost executor costs nothing that came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    _made.append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list]:
    """Tables that are settled inside are removed at the end, when nothing reads them any
    more, but for those put in the list: what the result is still read from."""
    first, kept = len(_made), []
    try:
        yield kept
    finally:
        paths = {df.settled_at for df in kept}
        for path in _made[first:]:
            if path not in paths:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        _made[first:] = [p for p in _made[first:] if p in paths]


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else kept; null becomes the empty text."""
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and what its
    allocators keep is taken from other workers of the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc's
except (OSError, AttributeError):
    _trim = None


class Recent(dict):
    """A dictionary of bounded size: at ``limit`` entries what is new becomes old, and
    the old goes; what ``missing`` finds among the old is new again."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: set) -> list:
        """Keys without an entry; those found among the old are taken over."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        rest = keys - self.keys()
        old = self.old
        self.update({k: old[k] for k in rest & old.keys()})
        return list(rest - old.keys())


#: Bits of the sketch that ``among`` broadcasts, in rows of 4 KB: 8 MB, whatever the ids.
SKETCH_BITS, ROW_BITS = 1 << 26, 1 << 15


def among(df: DataFrame, key: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of df whose key is among ids (distinct). First by a bitmap of fixed size over
    hashed ids, which is broadcast, so that most other rows are never shuffled; then
    exactly, by a merge join of what is left. With more ids than the bitmap can tell
    apart, the join does all the work."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SKETCH_BITS))
    bits = ids.select(place(id_col).alias("p")).groupBy((F.col("p") / ROW_BITS).cast("int").alias("__row")).agg(F.bitmap_construct_agg(F.col("p") % ROW_BITS).alias("__bits"))
    near = df.withColumn("__p", place(key)).withColumn("__row", (F.col("__p") / ROW_BITS).cast("int")).join(F.broadcast(bits), "__row")  # at most 2048 rows
    at = (F.col("__p") % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substr("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = near.filter(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1).select(*df.columns)
    return near.hint("merge").join(ids.select(F.col(id_col).alias("__id")), F.col(key) == F.col("__id"), "left_semi")
