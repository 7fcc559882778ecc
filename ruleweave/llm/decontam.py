"""Benchmark decontamination with DataFrame functions only.

Items and documents are lower-cased (A-Z) and cut into words. A window is n
consecutive words of an item, or the whole of a shorter item. Two steps find the
windows in a document:

1. A bitmap of the windows' hashes, a literal of bounded size, tests each
   position of the document. The hash takes four spread words of the window, so
   the test is necessary for a match and never misses one. It has 16 bits a
   window or more up to 8 million windows; beyond, more places are looked up.
2. The positions that pass give their whole window as a string, which is joined
   with the distinct windows of the items: equality of all words verifies the
   hit. The windows are broadcast below BROADCAST_WINDOWS rows; above, the join
   is shuffled.

One pass over the texts; only hits and one short row per document are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import cut

#: Windows up to which they are broadcast (each has a few hundred bytes); bits of the bitmap for these at most, and at most at all (16 MB).
BROADCAST_WINDOWS, SMALL_BITS, MAX_BITS = 100_000, 1 << 21, 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text.cast("string"), UPPER, LOWER), GAP), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (window, m, item_ids): the words joined by spaces, their number, the items that hold it."""
    worded = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    worded = worded.withColumn("m", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("m"))
    each = worded.select("item", "m", "w", F.explode(starts).alias("at")).select("item", "m", F.array_join(F.slice("w", F.col("at") + 1, F.col("m")), " ").alias("window"))
    return each.groupBy("window", "m").agg(F.collect_set("item").alias("item_ids"))


def _spread(m: int) -> list[int]:
    return sorted({0, m // 3, 2 * m // 3, m - 1})


def _bit(m: int, bits: int, get: Callable[[int], Column]) -> Column:
    """The place in the bitmap of a window whose word k is get(k)."""
    return F.xxhash64(F.lit(m), *[get(k) for k in _spread(m)]).bitwiseAND(F.lit(bits - 1))


def _bitmap(places: DataFrame, bits: int) -> Column:
    """A literal of bits / 64 numbers with the bits of `places` set."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))
    filled = {r["word"]: r["mask"] for r in places.select(F.floor(F.col("bit") / 64).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()}
    return F.from_json(F.lit(json.dumps([filled.get(k, 0) for k in range(bits // 64)])), "array<bigint>")


def _tester(m: int, bits: int, bitmap: Column) -> Callable[[Column], Column]:
    def passes(at: Column) -> Column:
        bit = _bit(m, bits, lambda k: F.get(F.col("w"), at + k))
        word = F.get(bitmap, F.call_function("shiftright", bit, F.lit(6)).cast("int"))
        return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


def _taker(m: int) -> Callable[[Column], Column]:
    return lambda at: F.struct(at.alias("at"), F.lit(m).alias("m"), F.concat_ws(" ", *[F.get(F.col("w"), at + k) for k in range(m)]).alias("window"))


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where the windows (distinct strings `window` of m words, and any further columns) stand in the documents.

    Rows: row (a number of a document row in this run), id, n_words, at (first
    word), m and the further columns of the window; these are null in the rows
    that keep documents, or places that only looked like one, without a window.
    Null and empty texts have no words; null ids, repeated rows and empty tables
    stay what they are; other columns of docs are dropped.
    """
    windows = cut(windows)
    lengths = {r["m"]: r["n"] for r in windows.groupBy("m").agg(F.count("*").alias("n")).collect()}  # a row per length
    total = sum(lengths.values())
    found = F.array().cast("array<struct<at:int,m:int,window:string>>")
    bits = 1 << 12
    while bits < min(MAX_BITS, max(min(SMALL_BITS, 256 * total), 16 * total)):
        bits *= 2
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    for m in sorted(lengths):
        own = windows.where(F.col("m") == m).select(_bit(m, bits, lambda k: F.get(F.split("window", " "), F.lit(k))).alias("bit"))
        bitmap = _bitmap(own, bits)
        starts = F.when(F.size("w") >= m, F.sequence(F.lit(0), F.size("w") - m))
        rows = rows.withColumn(f"found{m}", F.filter(starts, _tester(m, bits, bitmap))).withColumn(f"found{m}", F.coalesce(F.transform(f"found{m}", _taker(m)), found))
    rows = rows.select("row", "id", F.size("w").alias("n_words"), F.explode_outer(F.flatten(F.array(found, *[F.col(f"found{m}") for m in lengths]))).alias("f"))
    keyed = windows.withColumnsRenamed({"window": "key_window", "m": "key_m"})
    keyed = F.broadcast(keyed) if total <= BROADCAST_WINDOWS else keyed.hint("merge")
    rows = rows.select("row", "id", "n_words", F.col("f.at").alias("at"), F.col("f.m").alias("m"), F.col("f.window").alias("window"))
    # Rows without a window are spread over all tasks of a shuffled join by a name that no window has.
    sought = F.coalesce("window", F.concat(F.lit("-"), F.col("row").cast("string")))
    return rows.join(keyed, (sought == F.col("key_window")) & (F.coalesce("m", F.lit(0)) == F.col("key_m")), "left").drop("window", "key_window", "key_m")


def find_hits(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: row (a number of this run), id, n_words, spans array<struct<at,m>> sorted, item_ids."""
    hits = occurrences(docs, item_windows(items, n, item_id_col, item_text_col), id_col, text_col)
    span = F.when(F.col("item_ids").isNotNull(), F.struct("at", "m"))
    return hits.groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Return id_col, n_words, n_hit, n_items, items_sha256, contaminated and spans of every row.

    A document is contaminated if some word is hit and hits are at least one in
    `one_in` of its words. spans are merged (first word, words) runs of hit words, for
    those who remove spans rather than documents. Null and empty texts have no
    words; repeated rows give repeated results; a null item id counts for its
    words but names no item; an empty benchmark hits nothing.
    """
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<at:int,m:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["at"] + F.element_at(done, -1)["m"] >= s["at"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["at"].alias("at"), F.greatest(F.element_at(done, -1)["m"], s["at"] + s["m"] - F.element_at(done, -1)["at"]).alias("m")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    hits = find_hits(docs, items, n, id_col, text_col, item_id_col, item_text_col).withColumn("spans", merged)
    hits = hits.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["m"]))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    enough = F.col("n_hit") * one_in >= F.col("n_words")
    return hits.select(F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & enough).alias("contaminated"), "spans")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; rows are matched by id and text.

    Null and empty texts, and rows with null ids, are judged like any other; repeated rows stay or go together.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = F.struct(F.col(id_col), F.sha2(F.col(text_col).cast("string"), 256).alias("sha"))
    found = decontaminate(docs.select(key.alias("__key"), text_col), items, **options | {"id_col": "__key"})
    bad = found.where("contaminated").select("__key").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__key"][id_col]) & F.sha2(docs[text_col].cast("string"), 256).eqNullSafe(bad["__key"]["sha"]), "left_anti")
