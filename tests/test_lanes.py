"""Training in lanes gives what steps one by one give, and far sooner; models are fitted and scored on Arrow batches."""

import copy
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.operators import lanes
from ruleweave.operators.kernels import Config, VotingUnit
from ruleweave.plans import queries
from ruleweave.plans.models import RuleModel, VanillaClassifier


def samples(n, f, seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 2, (n, f))
    return x, x[:, 0] ^ x[:, -1] ^ (r.random(n) < 0.3)


def plainly(model, x, y, epochs=1):
    for index, unit in enumerate(model.units):
        RuleModel._epochs(model, unit, index, x, np.asarray(y, float), epochs, 0)
    return model


def state(unit):
    return unit.bank.ta.tolist(), unit.bank.words.tolist(), unit.weight.tolist(), unit.generator.bit_generator.state


@pytest.mark.parametrize(
    "config",
    [
        Config(9, 10, 10, 3.0, seed=7),
        Config(12, 12, 32, 2.0, seed=1),
        Config(1, 2, 1, 1.5, seed=2, state_bits=2),
        Config(7, 9, 15, 3.9, seed=3, state_bits=3, class_weights=(0.3, 2.5)),
        Config(5, 3, 4, 10.0, seed=4, state_bits=5, class_weights=(2.5, 0.3)),
    ],
)
def test_lanes_are_steps(config):
    """Counters that reach their top or zero, weights at their bounds, and blocks of any length are among them."""
    x, y = samples(lanes.BLOCK + 1500, config.n_features, config.seed)
    for number in (0, 1):
        one = VotingUnit(config, number)
        other = copy.deepcopy(one)
        for bits, own in zip(x, y.tolist()):
            one.update(bits, bool(own))
        assert lanes.fits(other)
        held = lanes.Lanes(other)
        for part in (slice(0, 1), slice(1, None)):
            held.train(lanes.numbers(x[part]), y[part] != 0)
        held.store()
        assert state(one) == state(other)


@pytest.mark.parametrize("weight", [0.05, 1.0, 1 / 3, 7.3])
def test_draws_at_a_level(weight):
    """A draw that equals a chance learns, the next larger one doesn't."""
    held = lanes.Lanes(VotingUnit(Config(3, 10, 17, 3.0, class_weights=(weight,))))
    chance = held.chance
    draws = np.concatenate([chance, np.nextafter(chance, 0), np.nextafter(chance, 2), [0.0, 1 - 2**-53]])
    draws = np.resize(draws[draws < 1], (40, 10))
    got = held._gates(draws).reshape(-1, len(draws))[: len(chance)]
    assert (got == ((draws <= chance[:, None, None]) << np.arange(10)).sum(axis=2)).all()


def test_small_models_train_in_lanes():
    """The registered query's model on 9,000,000 rows is a matter of minutes, so a step must not cost what numpy's calls cost."""
    x, y = samples(5000, 9, 5)
    took = []
    for train in (lambda m: m.fit_local(x, y, 2), lambda m: plainly(m, x, y, 2)):
        model, began = VanillaClassifier(2, 9, 10, 10, 3.0, seed=7), time.process_time()
        train(model)
        took.append((time.process_time() - began, [state(u) for u in model.units]))
    assert took[0][1] == took[1][1] and 4 * took[0][0] < took[1][0]


@pytest.mark.parametrize("options", [dict(boost=False), dict(clause_drop=0.1), dict(literal_drop=0.1), dict(type_iii=20.0), dict(max_included=3)])
def test_other_feedback_stays_with_numpy(options):
    assert not lanes.fits(VotingUnit(Config(9, 10, 10, 3.0, **options)))


def test_registered_model_is_plain(spark):
    """Fitted in lanes on executors, a unit a partition, the model is the one of steps one by one over all orders."""
    rows = queries._samples(spark, "/root/testdata/sf0.001")
    held = rows.orderBy("row_id").collect()
    model = plainly(VanillaClassifier(2, 9, 10, 10, 3.0, seed=7), np.array([r["bits"] for r in held]), [r["label"] for r in held], 2)
    fitted = VanillaClassifier(2, 9, 10, 10, 3.0, seed=7).fit(rows, epochs=2)
    assert [state(u) for u in fitted.units] == [state(u) for u in model.units]


def test_units_have_partitions(spark, monkeypatch):
    """Units train beside each other, whatever their numbers hash to."""
    df = spark.range(20).selectExpr("id as row_id", "array(1, 0, 1) as bits", "cast(id % 5 as int) as label")
    seen, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: seen.append(self) or plain(self, *a, **k))
    VanillaClassifier(5, 3, 4, 5, 3.0).fit(df)
    dealt = next(d for d in seen if "unit" in d.columns).groupBy(F.spark_partition_id()).agg(F.count_distinct("unit").alias("units"), F.count("*").alias("n")).collect()
    assert [(r["units"], r["n"]) for r in dealt] == [(1, 20)] * 5


def test_scored_rows_keep_their_columns(spark):
    model = VanillaClassifier(2, 3, 4, 5, 3.0, seed=1)
    df = spark.sql("select id, timestamp'2024-02-03 04:05:06' as at, if(id % 2 = 0, null, 'x') as name, array(cast(id & 1 as tinyint), cast(0 as tinyint), cast(1 as tinyint)) as bits from range(7)")
    got = model.transform(df)
    assert got.columns == ["id", "at", "name", "bits", "prediction", "scores"]
    rows = got.orderBy("id").collect()
    x = np.array([r["bits"] for r in rows])
    assert [r["prediction"] for r in rows] == model.predict(x).tolist() and [r["scores"] for r in rows] == model.scores(x).tolist()
    assert [r[:4] for r in rows] == [tuple(r) for r in df.orderBy("id").collect()]
    uneven = spark.sql("select id, if(id = 3, array(1), array(1, 0, 1)) as bits from range(7)").coalesce(1)
    with pytest.raises(Exception, match="same number"):
        model.transform(uneven).collect()
