"""Quality measures; each is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """(accuracy, n); null over no rows."""
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """(tp, fp, tn, fn, precision, recall) of 0/1 columns; a ratio over nothing is 0."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    counts = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    return counts.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def regression_errors(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """(mae, rmse)."""
    error = F.col(prediction) - F.col(target)
    return df.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def reconstruction_accuracy(reconstructed: DataFrame, samples: DataFrame) -> DataFrame:
    """(accuracy, n) over (row, output) pairs of reconstructed (row_id, output, bit)."""
    actual = samples.select("row_id", F.posexplode("bits").alias("output", "actual"))
    return accuracy(reconstructed.join(actual, ["row_id", "output"]), "bit", "actual")


def feature_errors(reconstructed: DataFrame, samples: DataFrame) -> DataFrame:
    """(output, error): share of rows whose bit is wrong."""
    actual = samples.select("row_id", F.posexplode("bits").alias("output", "actual"))
    return reconstructed.join(actual, ["row_id", "output"]).groupBy("output").agg(F.avg((F.col("bit") != F.col("actual")).cast("double")).alias("error"))


def top_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    """The n outputs of feature_errors with the largest error; of equal ones, the smaller output."""
    return errors.orderBy(F.desc("error"), "output").limit(n)


def row_errors(reconstructed: DataFrame, samples: DataFrame) -> DataFrame:
    """(row_id, error): share of bits that are wrong."""
    actual = samples.select("row_id", F.posexplode("bits").alias("output", "actual"))
    return reconstructed.join(actual, ["row_id", "output"]).groupBy("row_id").agg(F.avg((F.col("bit") != F.col("actual")).cast("double")).alias("error"))


def group_errors(errors: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, n, error) for each row of groups: mean error of its rows, 0 where there is none."""
    found = errors.groupBy(key).agg(F.count("*").alias("n"), F.avg("error").alias("error"))
    return groups.select(key).join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("error", F.lit(0.0)).alias("error"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): total / (classes * count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))
