"""Structured Streaming: windowed features, scoring, online training and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.logs import window_features
from ruleweave.plans.models import RuleModel
from ruleweave.sources import artifacts


def windowed_features(events: DataFrame, ts: str, width: str, late: str, tokens: list[str], token: Column, entity: Column) -> DataFrame:
    """Features of tumbling windows of a stream; events later than `late` are left out, and a window is given once it can't change."""
    return window_features(events.withWatermark(ts, late), ts, width, tokens, token, entity)


def score_stream(events: DataFrame, model: RuleModel, bits: str = "bits") -> DataFrame:
    """A stream of samples with prediction, scores and margin (best less second-best score)."""
    ordered = F.sort_array("scores", asc=False)
    return model.transform(events, bits).withColumn("margin", F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0)))


def train_stream(events: DataFrame, model: RuleModel, checkpoint: str, label: str | None = "label", bits: str = "bits", key: str = "row_id", epochs: int = 1, save_to: str | None = None, **trigger):
    """Train on each micro-batch; after each, the model is an artifact `save_to`/batch=N if asked for. Returns the query.

    A batch that is given again after a failure finds its artifact and is not trained twice.
    """
    trigger = trigger or {"availableNow": True}

    def learn(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{save_to}/batch={number}"
        if save_to is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                model.__dict__.update(artifacts.load(spark, path).__dict__)
                return
        batch.persist()
        if not batch.isEmpty():
            model.fit(batch, label=label, bits=bits, key=key, epochs=epochs)
        if save_to is not None:
            artifacts.save(spark, model, path)
        batch.unpersist()

    return events.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def grow_and_train(batch: DataFrame, encoder, model: RuleModel, label: str = "label", tokens: str = "tokens", key: str = "row_id", epochs: int = 1) -> int:
    """Take up a batch's new tokens, widen the model without forgetting, train on the batch; returns how many features came."""
    added = encoder.extend_categorical(batch, tokens)
    if added:
        model.grow_features(encoder.n_features())
    model.fit(encoder.encode(batch, tokens), label=label, key=key, epochs=epochs)
    return added
