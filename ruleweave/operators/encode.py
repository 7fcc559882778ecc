"""Fitted encoders: rows to Boolean features. An encoder's state is a small table, `encoder_bits`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.functions.bits import as_bits, thermometer
from ruleweave.functions.text import column_prefix

UNKNOWN, OOV = "<UNK>", "<OOV>"


def quantile_thresholds(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(feature, t, threshold): for each column, element floor((n - 1)(t + 1) / (k + 1)) of its sorted values.

    Values are ranked without a global sort: equal values are counted, the values
    of a feature are cut into 4096 ranges, and running counts within and across
    the ranges give ranks, so a skewed feature is sorted by many tasks.
    Nulls are left out; NaN sorts last.
    """
    if not columns or k < 1:
        raise ValueError("at least one column and one threshold are needed")
    values = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("feature", "value")).where("value is not null")
    counted = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    bounds = counted.groupBy("feature").agg(F.min(F.when(~F.isnan("value"), F.col("value"))).alias("low"), F.max(F.when(~F.isnan("value"), F.col("value"))).alias("high"), F.sum("n").alias("total"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    bucket = F.when(F.isnan("value"), 4096).otherwise(F.least(F.lit(4095), F.floor((F.col("value") - F.col("low")) / width * 4096))).cast("int")
    placed = counted.join(F.broadcast(bounds), "feature").withColumn("bucket", bucket)
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("feature", "bucket").agg(F.sum("n").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    within = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("up_to", F.sum("n").over(within)).join(buckets.select("feature", "bucket", "before"), ["feature", "bucket"])
    ranked = ranked.select("feature", "value", "total", (F.col("before") + F.col("up_to")).alias("last"), (F.col("before") + F.col("up_to") - F.col("n")).alias("first"))
    wanted = ranked.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("rank", F.expr(f"((total - 1) * (t + 1)) div {k + 1}"))
    return wanted.where("rank >= first and rank < last").select("feature", "t", F.col("value").alias("threshold"))


@dataclass
class Encoder:
    """kind `binary` (width), `numeric` (columns, thresholds) or `categorical` (vocabulary: token -> bit, unknowns: column -> bit, oov)."""

    kind: str
    width: int = 0
    columns: list[str] = field(default_factory=list)
    thresholds: list[list[float]] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    unknowns: dict[str, int] = field(default_factory=dict)
    oov: int = -1

    @staticmethod
    def for_binary(n_features: int) -> "Encoder":
        if n_features < 1:
            raise ValueError("at least one feature is needed")
        return Encoder("binary", n_features)

    @staticmethod
    def fit_numeric(df: DataFrame, columns: list[str], k: int) -> "Encoder":
        rows = quantile_thresholds(df, columns, k).orderBy("feature", "t").collect()  # columns x k rows
        if len(rows) != len(columns) * k:
            raise ValueError("every column needs a value")
        return Encoder("numeric", len(rows), list(columns), [[r["threshold"] for r in rows if r["feature"] == f] for f in range(len(columns))])

    @staticmethod
    def vocabulary_table(df: DataFrame, tokens: str = "tokens") -> DataFrame:
        """(token, bit, kind): distinct tokens in byte order, then each column's unknown, then the catch-all."""
        seen = df.select(F.explode(tokens).alias("token")).where("token is not null").distinct()
        unknown = seen.select(F.concat(column_prefix(F.col("token")), F.lit(f"::{UNKNOWN}")).alias("token")).distinct()
        every = seen.select("token", F.lit(0).alias("k")).unionByName(unknown.join(seen, "token", "left_anti").select("token", F.lit(1).alias("k")))
        every = every.unionByName(df.sparkSession.range(1).select(F.lit(OOV).alias("token"), F.lit(2).alias("k")))
        # A vocabulary is a model's width: it fits one sorted partition.
        bit = F.row_number().over(Window.orderBy("k", "token")) - 1
        return every.select("token", bit.alias("bit"), F.element_at(F.array(F.lit("token"), F.lit("unknown"), F.lit("oov")), F.col("k") + 1).alias("kind"))

    @staticmethod
    def fit_categorical(df: DataFrame, tokens: str = "tokens") -> "Encoder":
        rows = Encoder.vocabulary_table(df, tokens).collect()
        vocabulary = {r["token"]: r["bit"] for r in rows if r["kind"] != "oov"}
        unknowns = {t.removesuffix(f"::{UNKNOWN}"): b for t, b in vocabulary.items() if t.endswith(f"::{UNKNOWN}")}
        return Encoder("categorical", len(rows), vocabulary=vocabulary, unknowns=unknowns, oov=next(r["bit"] for r in rows if r["kind"] == "oov"))

    def extend_categorical(self, df: DataFrame, tokens: str = "tokens") -> int:
        """Append unseen tokens, then unknowns of new columns; bits that exist never move. Returns how many were added."""
        self._need("categorical")
        spark = df.sparkSession
        known = spark.createDataFrame([(t,) for t in [*self.vocabulary, OOV]], "token string")
        new = [r["token"] for r in df.select(F.explode(tokens).alias("token")).where("token is not null").distinct().join(known, "token", "left_anti").orderBy("token").collect()]
        before = self.width
        for t in new:
            self.vocabulary[t] = self.width
            self.width += 1
        for column in sorted({t.split("::", 1)[0] for t in new} - self.unknowns.keys()):
            name = f"{column}::{UNKNOWN}"
            if name not in self.vocabulary:
                self.vocabulary[name] = self.width
                self.width += 1
            self.unknowns[column] = self.vocabulary[name]
        return self.width - before

    def grow_binary(self, n_features: int) -> None:
        self._need("binary")
        if n_features < self.width:
            raise ValueError("features can't shrink")
        self.width = n_features

    def n_features(self) -> int:
        return self.width

    def bit_origin(self, bit: int) -> tuple[int, float]:
        """(feature, threshold) of a bit of a numeric encoder."""
        self._need("numeric")
        if not 0 <= bit < self.width:
            raise IndexError(bit)
        k = len(self.thresholds[0])
        return bit // k, self.thresholds[bit // k][bit % k]

    def vocab_token(self, bit: int) -> str:
        self._need("categorical")
        if not 0 <= bit < self.width:
            raise IndexError(bit)
        return self._tokens()[bit]

    def _tokens(self) -> list[str]:
        """Tokens by bit."""
        out = [OOV] * self.width
        for token, bit in self.vocabulary.items():
            out[bit] = token
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """encoder_bits: (bit, kind, feature, threshold, token)."""
        if self.kind == "numeric":
            rows = [(bit, self.kind, *self.bit_origin(bit), None) for bit in range(self.width)]
        else:
            names = self._tokens() if self.kind == "categorical" else [None] * self.width
            rows = [(bit, self.kind, bit, None, names[bit]) for bit in range(self.width)]
        return spark.createDataFrame(rows, "bit int, kind string, feature int, threshold double, token string")

    def encode(self, df: DataFrame, source: str | None = None, into: str = "bits") -> DataFrame:
        """df with `bits array<tinyint>`: from an array column (binary, default `bits`; categorical, default `tokens`) or the fitted columns."""
        if self.kind == "numeric":
            parts = [thermometer(F.col(c).cast("double"), F.array(*[F.lit(float(t)) for t in ts])) for c, ts in zip(self.columns, self.thresholds)]
            return df.withColumn(into, F.flatten(F.array(*parts)))
        if self.kind == "binary":
            given = as_bits(F.col(source or "bits"))
            padded = F.concat(given, F.array_repeat(F.lit(0).cast("tinyint"), F.greatest(F.lit(0), F.lit(self.width) - F.size(given))))
            return df.withColumn(into, F.when(F.size(given) > self.width, F.raise_error(F.lit("a row has more features than its encoder"))).otherwise(padded))
        true = self.true_bits(F.col(source or "tokens"))
        return df.withColumn(into, F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.array_contains(true, i).cast("tinyint")))

    def true_bits(self, tokens: Column) -> Column:
        """Bits set by a row's tokens: its own, else its column's unknown, else the catch-all."""
        self._need("categorical")
        known = F.from_json(F.lit(_json(self.vocabulary)), "map<string,int>")
        unknown = F.from_json(F.lit(_json(self.unknowns)), "map<string,int>")
        return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.try_element_at(unknown, column_prefix(t)), F.lit(self.oov))))

    def encode_relational(self, df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
        """(key, bit) of categorical rows, by joins with the vocabulary: for vocabularies too wide for an expression."""
        spark = df.sparkSession
        vocabulary = spark.createDataFrame(list(self.vocabulary.items()), "token string, own int")
        unknown = spark.createDataFrame(list(self.unknowns.items()) or [("", -1)], "col string, unk int")
        each = df.select(key, F.explode(tokens).alias("token")).withColumn("col", column_prefix(F.col("token")))
        joined = each.join(vocabulary, "token", "left").join(unknown, "col", "left")
        return joined.select(key, F.coalesce("own", "unk", F.lit(self.oov)).alias("bit")).distinct()

    def _need(self, kind: str) -> None:
        if self.kind != kind:
            raise TypeError(f"this encoder is {self.kind}, not {kind}")


def bits_of_words(words: Column, n_features: int) -> Column:
    """`bits` of a custom sample given as literal words of 64 bits (features first, then their negations), as bits.pack makes them.

    A row of another number of words is an error.
    """
    n_words = -(-2 * n_features // 64)
    bit = lambda k: F.call_function("shiftrightunsigned", F.get(words, F.call_function("shiftright", k, F.lit(6))), k.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)).cast("tinyint")
    found = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), bit)
    return F.when(F.size(words) == n_words, found).otherwise(F.raise_error(F.lit(f"a sample has not {n_words} words")))


def bits_of_rows(rows: Column, n_features: int) -> Column:
    """`bits` of a custom sample given as one number a feature: what isn't zero is 1. A row of another length is an error."""
    found = F.transform(rows, lambda v: (v != 0).cast("tinyint"))
    return F.when(F.size(rows) == n_features, found).otherwise(F.raise_error(F.lit(f"a sample has not {n_features} features")))


def _json(value: dict) -> str:
    import json

    return json.dumps(value)
