"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one group and never part. Groups stand in a fixed
pseudo-random order (block, hash of the text); their byte sizes have prefix
sums, and a shard is a run of groups. The smallest capacity C for which a greedy
pass needs no more than n_shards runs is found by binary search, and the runs
are cut there.

Nothing of the size of the input reaches the driver. A greedy pass asks "the
last group end at or below x" n_shards times; the driver answers from a summary
of (smallest, largest) ends in at most BINS intervals, as a range [low, high].
If the low answers cover everything, C is feasible; if the high answers don't,
it isn't; else only the intervals that left it open are refined, by one job that
returns at most FINE intervals for each. Everything else is DataFrame functions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.common import cut

#: Blocks that prefix sums are made in, intervals of the first summary, of one refinement, and slots' salts.
BLOCKS, BINS, FINE, SALTS = 65_536, 65_536, 512, 64
SCHEMA = "size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


class Ends:
    """Group ends (prefix sums of bytes), known as intervals that are refined on demand."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.total, self.jobs = groups, total, 0
        self.low, self.high = [0], [0]
        self._put([(0, total)], BINS)

    def _put(self, open_: list[tuple[int, int]], parts: int) -> None:
        """Replace each open (low, high) by the non-empty ones of its parts."""
        which = part = None
        for i, (low, high) in enumerate(open_):
            inside, width = F.col("end").between(low, high), max(1, -(-(high - low + 1) // parts))
            at = F.floor((F.col("end") - low) / width)
            which = F.when(inside, i) if which is None else which.when(inside, i)
            part = F.when(inside, at) if part is None else part.when(inside, at)
        found = self.groups.select("end", which.alias("i"), part.alias("part")).where("i is not null").groupBy("i", "part").agg(F.min("end").alias("low"), F.max("end").alias("high")).collect()
        self.jobs += 1
        replaced = set(open_)
        kept = [x for x in zip(self.low, self.high) if x not in replaced]
        every = sorted(kept + [(r["low"], r["high"]) for r in found])
        self.low, self.high = [x[0] for x in every], [x[1] for x in every]

    def refine(self, open_: set[tuple[int, int]]) -> None:
        self._put(sorted(open_), FINE)

    def last(self, x: int, open_: set) -> tuple[int, int]:
        """Bounds of the largest end that is x or less."""
        at = bisect_right(self.low, x) - 1
        if self.high[at] <= x:
            return self.high[at], self.high[at]
        open_.add((self.low[at], self.high[at]))
        return self.low[at], x

    def first(self, x: int, open_: set) -> tuple[int, int]:
        """Bounds of the smallest end that is x or more."""
        at = bisect_left(self.high, x)
        if self.low[at] >= x:
            return self.low[at], self.low[at]
        open_.add((self.low[at], self.high[at]))
        return x, self.high[at]

    def exact(self, ask, x: int) -> int:
        while True:
            open_: set = set()
            low, high = ask(x, open_)
            if low == high or not open_:
                return low
            self.refine(open_)

    def feasible(self, capacity: int, shards: int) -> bool:
        """Whether a greedy pass with this capacity ends within so many shards."""
        while True:
            low = high = 0
            open_: set = set()
            for _ in range(shards):
                low, high = self.last(min(low + capacity, self.total), open_)[0], self.last(min(high + capacity, self.total), open_)[1]
            if low >= self.total:
                return True
            if high < self.total:
                return False
            self.refine(open_)


def minimax_cuts(ends: Ends, shards: int, largest: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, end of each shard).

    Of the partitions with that capacity, the one that keeps each cut as near
    below its even share as the capacity allows, so that the last shards are not
    left short.
    """
    total = ends.total
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if ends.feasible(middle, shards) else (middle + 1, high)
    least = [total]
    for _ in range(shards - 1):
        least.append(ends.exact(ends.first, max(0, least[-1] - low)))
    cuts, at = [], 0
    for j, needed in enumerate(least[-2::-1], 1):
        at = ends.exact(ends.last, min(at + low, max(needed, total * j // shards)))
        cuts.append(at)
    return low, [*cuts, total]


def shard_rows(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard by the law `bytes`.

    Returns id_col, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard,
    slot (0, 1, ... in each shard) and grown_shard (null under this law). A null
    text counts as an empty one; rows with null or repeated ids get slots of
    their own; with fewer groups than shards, some shards stay empty; an empty
    table gives no rows; other columns are dropped.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = cut(rows)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)))
    # One row a block, BLOCKS at most.
    blocks = groups.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    within = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumns({"end": F.sum("bytes").over(within), "n_end": F.sum("n").over(within)}).join(F.broadcast(blocks), "block")
    groups = cut(groups.select("key", "bytes", "n", (F.col("end") + F.col("bytes_before")).alias("end"), (F.col("n_end") + F.col("n_before")).alias("n_end")))
    total, largest = groups.agg(F.max("end"), F.max("bytes")).first()
    if total is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {dict(docs.dtypes)[id_col]}, {SCHEMA}")
    _, cuts = minimax_cuts(Ends(groups, total), n_shards, largest)
    starts = [0, *cuts[:-1]]
    counted = {r["end"]: r["n_end"] for r in groups.where(F.col("end").isin(sorted(set(starts)))).select("end", "n_end").collect()} | {0: 0}
    shard, rows_before = F.lit(0), F.lit(0)
    for j, start in enumerate(starts):
        shard, rows_before = F.when(F.col("end") > start, j).otherwise(shard), F.when(F.col("end") > start, counted[start]).otherwise(rows_before)
    groups = groups.select("key", shard.alias("shard"), (F.col("n_end") - F.col("n") - rows_before).alias("first"))
    # A row's place in its group, in SALTS parts, so that a hot group is numbered by many tasks.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "salt").agg(F.count("*").alias("n"))
    parts = parts.select("key", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_first"))
    parts = parts.join(groups, "key").select("key", "salt", "shard", (F.col("first") + F.col("part_first")).alias("first"))
    placed = salted.withColumn("at", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id")) - 1).join(parts, ["key", "salt"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
