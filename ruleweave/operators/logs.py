"""Log preparation: token counts, top tokens, tumbling windows and their features, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions import text as T
from ruleweave.functions.bits import count_thermometer

#: Thresholds of window features.
TOKEN_THRESHOLDS, EVENT_THRESHOLDS, DISTINCT_THRESHOLDS = [1, 3, 10], [5, 20, 50, 100], [2, 5, 10]


def token_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n)."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_tokens(df: DataFrame, tokens: Column, k: int) -> DataFrame:
    """The k most frequent tokens; of equal counts, the smaller token."""
    return token_frequency(df, tokens).orderBy(F.desc("n"), "token").limit(k)


def keep_tokens(df: DataFrame, key: str, tokens: Column, kept: DataFrame) -> DataFrame:
    """(key, token) of the tokens that stand in kept."""
    return df.select(key, F.explode(tokens).alias("token")).join(kept.select("token"), "token", "left_semi")


def window_counts(events: DataFrame, ts: str, width: str, token: Column) -> DataFrame:
    """(window_start, token, n) of tumbling windows; windows without an event don't appear."""
    return events.groupBy(F.window(ts, width).start.alias("window_start"), token.alias("token")).agg(F.count("*").alias("n"))


def window_features(events: DataFrame, ts: str, width: str, tokens: list[str], token: Column, entity: Column) -> DataFrame:
    """(window_start, n_events, n_distinct, bits) of tumbling windows: one aggregate, thermometers of counts.

    Bits: each token against TOKEN_THRESHOLDS, then events, then distinct
    entities. With a watermark on ts the same plan runs on a stream, where
    distinct entities are approximate (exact counts need unbounded state).
    """
    distinct = F.approx_count_distinct(entity) if events.isStreaming else F.count_distinct(entity)
    counts = [F.count_if(token == t).alias(f"c{i}") for i, t in enumerate(tokens)]
    grouped = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n_events"), distinct.alias("n_distinct"), *counts)
    bits = F.flatten(F.array(*[count_thermometer(F.col(f"c{i}"), TOKEN_THRESHOLDS) for i in range(len(tokens))], count_thermometer(F.col("n_events"), EVENT_THRESHOLDS), count_thermometer(F.col("n_distinct"), DISTINCT_THRESHOLDS)))
    return grouped.select(F.col("w.start").alias("window_start"), "n_events", "n_distinct", bits.alias("bits"))


def json_tokens(df: DataFrame, key: str, column: str, deny: tuple[str, ...] = ()) -> DataFrame:
    """(key, token) `name::value` of the scalars of JSON objects of any schema; malformed text, nulls, arrays, objects, denied and empty values are skipped."""
    parsed = F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})
    kept = F.filter(F.map_entries(parsed), lambda e: ~e["key"].isin(*deny) & e["value"].isNotNull() & (e["value"] != "") & ~e["value"].rlike(r"^\s*[\[{]") if deny else e["value"].isNotNull() & (e["value"] != "") & ~e["value"].rlike(r"^\s*[\[{]"))
    return df.select(key, F.explode(F.transform(kept, lambda e: F.concat(e["key"], F.lit("::"), e["value"]))).alias("token"))


def event_tokens(json: Column, event: Column) -> Column:
    """Tokens of an event of any schema, a JSON object.

    First `event.id::N`; then, in the order of the fields, the tokens of command
    lines; of registry paths the hive; of other paths the base name and the places
    they go through; else the value. Fields have their common names. Skipped
    fields, nulls, arrays, objects and empty values give none; text that is no
    object has its event's token alone.
    """
    fields = F.map_entries(F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"}))
    kept = F.filter(fields, lambda e: e["value"].isNotNull() & (e["value"] != "") & ~e["key"].isin(*T.SKIPPED_FIELDS) & ~e["value"].rlike(r"^\s*[\[{]"))

    def of_field(e: Column) -> Column:
        name, value = T.common_name(e["key"]), e["value"]
        named = lambda v: F.concat(name, F.lit("::"), v)
        line = lambda prefix: F.transform(T.command_tokens(value), lambda t: F.concat(F.lit(prefix), t))
        path = F.contains(value, F.lit("\\")) | F.contains(value, F.lit("/"))
        return (
            F.when(e["key"] == "CommandLine", line("process.args::"))
            .when(e["key"] == "ParentCommandLine", line("process.parent.args::"))
            .when(T.is_hive(value, tuple(T.EVENT_HIVES)), F.array(named(T.hive(value))))
            .when(path, F.concat(F.array(named(T.basename(value))), T.place_tokens(value)))
            .otherwise(F.array(named(value)))
        )

    return F.concat(F.array(F.concat(F.lit("event.id::"), event.cast("string"))), F.coalesce(F.flatten(F.transform(kept, of_field)), F.array().cast("array<string>")))


def process_tokens(image: Column, parent: Column, user: Column, integrity: Column, company: Column, signed: Column) -> Column:
    """Tokens of a process event: its six fields, and the edge from its parent."""
    named = {"Image": image, "ParentImage": parent, "User": user, "IntegrityLevel": integrity, "Company": company, "Signed": signed.cast("string")}
    return F.array(*[T.token(k, v) for k, v in named.items()], F.concat(F.lit("edge::"), parent, F.lit("->"), image))


def window_vocabulary(events: DataFrame, tokens: Column) -> DataFrame:
    """(token, place) of the distinct tokens in their order, by which windows are encoded. A vocabulary is a model's width."""
    seen = events.select(F.explode(tokens).alias("token")).distinct()
    return seen.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("place"))


def window_feature_names(tokens: list[str], entity: str = "images") -> list[str]:
    """Names of the bits of windows, in the order of window_bits."""
    names = [f"count({t}) >= {k}" for t in tokens for k in TOKEN_THRESHOLDS]
    return names + [f"window_events >= {k}" for k in EVENT_THRESHOLDS] + [f"distinct_{entity} >= {k}" for k in DISTINCT_THRESHOLDS]


def window_bits(events: DataFrame, window: str, tokens: Column, entity: str, vocabulary: DataFrame) -> DataFrame:
    """(window, bit, value) of the bits that are 1, by joins: for vocabularies too wide for one row's expression."""
    counted = events.select(window, F.explode(tokens).alias("token")).groupBy(window, "token").agg(F.count("*").alias("c")).join(vocabulary, "token")
    levels = lambda ks: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(ks)])).alias("t")
    own = counted.select(window, "place", "c", levels(TOKEN_THRESHOLDS)).where(F.col("c") >= F.col("t.k")).select(window, (F.col("place") * len(TOKEN_THRESHOLDS) + F.col("t.i")).cast("int").alias("bit"))
    width = vocabulary.agg((F.count("*") * len(TOKEN_THRESHOLDS)).alias("width"))
    totals = events.groupBy(window).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("d")).crossJoin(F.broadcast(width))
    whole = totals.select(window, "width", "n", levels(EVENT_THRESHOLDS)).where(F.col("n") >= F.col("t.k")).select(window, (F.col("width") + F.col("t.i")).cast("int").alias("bit"))
    several = totals.select(window, "width", "d", levels(DISTINCT_THRESHOLDS)).where(F.col("d") >= F.col("t.k")).select(window, (F.col("width") + len(EVENT_THRESHOLDS) + F.col("t.i")).cast("int").alias("bit"))
    return own.unionByName(whole).unionByName(several)


def cut_at(df: DataFrame, key: str, numerator: int = 4, denominator: int = 5, seed: int = 0) -> DataFrame:
    """df with train: true for the first n * numerator / denominator rows (whole part) in a hashed order of the key.

    The cut is exact. Rows are counted in 4096 ranges of the hash; only the range that holds the cut is ranked.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    placed = df.withColumns({"__hash": order, "__range": F.shiftrightunsigned(order, 52)})
    counts = placed.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()  # 4096 rows at most
    left, at, rest = sum(r["n"] for r in counts) * numerator // denominator, 1 << 12, 0
    for r in counts:
        if left < r["n"]:
            at, rest = r["__range"], left
            break
        left -= r["n"]
    on = placed.where(F.col("__range") == at).withColumn("train", F.row_number().over(Window.partitionBy("__range").orderBy("__hash", key)) <= rest)
    off = placed.where(F.col("__range") != at).withColumn("train", F.col("__range") < at)
    return off.unionByName(on).drop("__hash", "__range")


def split(df: DataFrame, key: str, numerator: int = 4, denominator: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: stable under any partitioning, without a shuffle."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(denominator))
    return df.where(bucket < numerator), df.where(bucket >= numerator)
