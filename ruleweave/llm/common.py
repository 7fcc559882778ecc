"""What several operators share: tables, durable cuts of lineage, worker caches."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    One is made here only where the session names none and the driver runs all tasks itself, as in tests.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ruleweave-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Have the executors collect garbage and return heap they don't use to the system.

    A JVM's heap grows with each stage and stays, while Python workers need their
    memory beside it. Two tasks for each core reach every executor that is idle; no
    result depends on it, and a JVM that is told to ignore such calls does.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 2 * cores, 1, 2 * cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; a lost executor loses none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def deal_out(placed: DataFrame, by: str, item: str, limit: int) -> DataFrame:
    """placed, dealt to partitions and sorted by a new column key, with a column side.

    Rows of one value of `by` share a key (side 0). Where a value has more than
    `limit` rows, they are cut into blocks by the hash of `item`, and each pair of
    blocks is a key of its own: rows of side 1 are to be compared with rows of
    side 2 there, and rows of side 0 with each other, so that all pairs meet once
    and no task holds more than 2 * limit rows or so.
    """
    crowded = placed.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    crowded = cut(crowded.select(by, F.ceil(F.col("n") / limit).cast("int").alias("blocks")))
    plain, block = placed, F.lit(0).cast("bigint")
    if crowded.count():
        hot = placed.join(crowded, by).withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
        hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.least("own", "other").cast("bigint") * 1_000_000 + F.greatest("own", "other") + 1
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
        hot = hot.select(*placed.columns, pair.alias("block"), side.alias("side"))
        plain = placed.join(crowded.select(by), by, "left_anti").select(*placed.columns, block.alias("block"), F.lit(0).alias("side"))
        dealt = plain.unionByName(hot)
    else:
        dealt = plain.select("*", block.alias("block"), F.lit(0).alias("side"))
    dealt = dealt.withColumn("key", F.xxhash64(by, "block")).drop("block")
    return dealt.repartition("key").sortWithinPartitions("key")


def spread_join(left: DataFrame, right: DataFrame, key: str, limit: int = 20_000) -> DataFrame:
    """left joined with right (one row per key at most, all keys of left) where one key may hold most rows of left.

    Keys with more than `limit` rows, or a 20,000th of all rows if that is more,
    are at most 20,000, a broadcast of bounded size. Their rows are dealt over
    blocks of about that limit, and their row of right is repeated once a block.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    limit = max(limit, (counts.agg(F.sum("n")).first()[0] or 0) // 20_000)
    crowded = cut(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__blocks")))
    if not crowded.count():
        return left.join(right, key)
    crowded = F.broadcast(crowded)
    item = F.xxhash64(*[c for c in left.columns if c != key]) if len(left.columns) > 1 else F.rand()
    blocks = F.coalesce("__blocks", F.lit(1))
    dealt = left.join(crowded, key, "left").withColumn("__block", F.pmod(item, blocks)).drop("__blocks")
    repeated = right.join(crowded, key, "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks.cast("bigint") - 1))).drop("__blocks")
    return dealt.join(repeated, [key, "__block"]).drop("__block")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, whatever task runs in it."""
    module = sys.modules.setdefault("_ruleweave_worker", types.ModuleType("_ruleweave_worker"))
    return module.__dict__.setdefault("store", {})


def worker_cache(key: tuple, make):
    """make(), once per worker; what stands under other keys goes."""
    store = worker_store()
    if key not in store:
        store.clear()
        tidy()
        store[key] = make()
    return store[key]


def tidy(collect: bool = True) -> None:
    """Give memory that is free in this process back to the system: workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def frugal(run, owner: str = ""):
    """run, a function of batches, in a worker that keeps nothing of other operators and is tidy after each task.

    Of what worker_cache keeps, only entries whose key begins with `owner` outlive the start of the task.
    """

    def tidied(batches):
        store = worker_store()
        for key in [k for k in store if k[0] != owner]:
            del store[key]
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


class Generations(dict):
    """A cache with a size bound: entries move on while they are used, the rest age out.

    At most 2 * limit entries are held; keys longer than `widest` are not, so the
    bytes held are bounded too. A value is always make(key).
    """

    def __init__(self, make, limit: int, widest: int = 64):
        super().__init__()
        self.make, self.limit, self.widest, self.old = make, limit, widest, {}

    def __missing__(self, key):
        if len(key) > self.widest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
