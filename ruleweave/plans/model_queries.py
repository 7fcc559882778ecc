"""Queries over models that were given fixed rules, and over single steps of training, with their DuckDB SQL.

The vectorised predictions of each family must give what the joins of
ruleweave.plans.queries give, so they share the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions import bits as B
from ruleweave.functions.rng import SplitMix64
from ruleweave.operators import inspect, kernels, metrics
from ruleweave.operators.encode import bits_of_rows, bits_of_words
from ruleweave.plans import models
from ruleweave.plans import queries as Q

_SHARED = [(0, c, f, n) for o, c, f, n in Q.RULES if o == 0]


def _vanilla(threshold: int = Q.THRESHOLD, swapped: bool = False) -> models.VanillaClassifier:
    weights = [(1 - o, c, w) for o, c, w in Q.WEIGHTS] if swapped else Q.WEIGHTS
    return models.VanillaClassifier(2, 9, 4, threshold, 3.0).set_rules(Q.RULES, weights)


def model_vanilla(spark, d):
    """Predictions of a given classifier over samples that come as literal words."""
    samples = Q._samples(spark, d).select("row_id", "label", bits_of_words(B.pack(F.col("bits"), 9), 9).alias("bits"))
    found = _vanilla().transform(samples)
    return found.select("prediction", F.get("scores", F.col("prediction")).alias("score"), "label").groupBy("prediction", "score", "label").agg(F.count("*").alias("n"))


def model_accuracy(spark, d):
    """Accuracy of a given sparse classifier over samples that come as rows of numbers."""
    samples = Q._samples(spark, d).select("row_id", "label", bits_of_rows(F.transform("bits", lambda b: b.cast("int") * 3), 9).alias("bits"))
    model = models.SparseClassifier(2, 9, 4, Q.THRESHOLD, 3.0).set_rules(Q.RULES, Q.WEIGHTS)
    return metrics.accuracy(model.transform(samples)).select(F.round("accuracy", 9).alias("accuracy"), "n")


def model_coalesced(spark, d):
    model = models.CoalescedClassifier(2, 9, 4, Q.THRESHOLD, 3.0).set_rules(_SHARED, Q.SHARED_WEIGHTS)
    return model.transform(Q._samples(spark, d)).groupBy("prediction").agg(F.count("*").alias("n"))


def model_composite(spark, d):
    model = models.CompositeClassifier([_vanilla(2), _vanilla(3, swapped=True)])
    return model.transform(Q._samples(spark, d)).groupBy("prediction").agg(F.count("*").alias("n"))


def _convolution(spark, d, kernel, shape):
    model = models.ConvolutionalClassifier(2, 64, 2, Q.THRESHOLD, 3.0, kernel, stride=2, shape=shape)
    wide = kernel if isinstance(kernel, int) else kernel[0] * kernel[1]
    model.set_rules([r for r in Q.PATCH_RULES if r[2] < wide], Q._CONV_W)
    return model.transform(Q._signs(spark, d)).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def model_convolution_1d(spark, d):
    return _convolution(spark, d, 3, ())


def model_convolution_2d(spark, d):
    return _convolution(spark, d, (2, 2), (8, 8))


def model_regressor(spark, d):
    rows, _, _ = Q._parts(spark, d)
    model = models.VanillaRegressor(3, 3, 30, 3.0).set_rules(Q._PART_RULES, Q._PART_W)
    return model.transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


def model_regressor_errors(spark, d):
    rows, _, _ = Q._parts(spark, d)
    model = models.VanillaRegressor(3, 3, 30, 3.0).set_rules(Q._PART_RULES, Q._PART_W)
    return spark.createDataFrame([(round(model.mae(rows), 6), round(model.rmse(rows), 6))], "mae double, rmse double")


def model_autoencoder(spark, d):
    """Errors of each output of a given shared autoencoder, the largest first."""
    samples = Q._signs(spark, d, 4)
    model = models.CoalescedAutoencoder(4, 3, 10, 3.0).set_rules(Q._AE_RULES, Q._AE_W)
    found = model.transform(samples).select("row_id", F.posexplode("reconstruction").alias("output", "bit"))
    return metrics.top_errors(metrics.feature_errors(found, samples), 10).select("output", F.round("error", 9).alias("error"))


def model_tables(spark, d):
    """Rules, weights, polarities and sizes that a model tells of itself."""
    model = _vanilla()
    rows = [(o, c, model.clause_weight(o, c), model.clause_is_positive(o, c), len(model.clause_rule(o, c)), " ".join(f"{'-' if n else ''}{f}" for f, n in model.clause_rule(o, c))) for o in range(model.n_classes()) for c in range(model.clauses_per_class())]
    shape = (model.n_features(), model.n_clauses(), model.threshold(), model.n_outputs(), model.words_per_sample(), *model.input_shape())
    return spark.createDataFrame([(*r, "/".join(map(str, shape))) for r in rows], "output int, clause int, weight int, positive boolean, n bigint, rule string, shape string")


def model_weights(spark, d):
    """A model's own tables, signed weights joined with the literals."""
    model = _vanilla()
    return model.clause_lits(spark).join(model.weights(spark), ["output", "clause"]).select("output", "clause", "feature", "negated", "state", "weight")


def top_indicators(spark, d):
    return inspect.top_indicators(_vanilla().clause_lits(spark), 4)


def first_rules(spark, d):
    return inspect.first_rules(_vanilla().clause_lits(spark), 3, longest=1)


def growth_of_models(spark, d):
    """Counters of a model that grew from 9 features to 11, by literal and state."""
    model = models.CoalescedClassifier(2, 9, 4, Q.THRESHOLD, 3.0).set_rules(_SHARED, Q.SHARED_WEIGHTS)
    model.grow_features(11)
    ta = model.units[0].bank.ta
    return spark.createDataFrame([(int(c), int(i), int(ta[c, i])) for c in range(4) for i in range(22)], "clause int, literal int, state int")


def _bank(states: np.ndarray, **options) -> kernels.Bank:
    bank = kernels.Bank(kernels.Config(states.shape[1] // 2, len(states), 10, 3.0, **options), np.random.default_rng(0))
    bank.ta[:] = states
    bank.refresh(slice(None))
    return bank


def training_type_i(spark, d):
    """Every state under Type I feedback: fired or not, present or not, drawn or not, with and without boost."""
    out = []
    for boost in (True, False):
        for fired in (True, False):
            for lit in (True, False):
                for draw in (True, False):
                    bank = _bank(np.arange(256, dtype=np.uint8)[:, None].repeat(2, axis=1), boost=boost)
                    rows, one = np.arange(256), np.full(2, True)
                    bank.type_i(rows, np.full(256, fired), one & lit, one, one & draw, one & draw)
                    out += [(boost, fired, lit, draw, s, int(t)) for s, t in enumerate(bank.ta[:, 0])]
    return spark.createDataFrame(out, "boost boolean, fired boolean, present boolean, drawn boolean, state int, after int")


def training_type_ii(spark, d):
    """Every state under Type II feedback of clauses that fired."""
    out = []
    for lit in (True, False):
        for active in (True, False):
            bank = _bank(np.arange(256, dtype=np.uint8)[:, None].repeat(2, axis=1))
            bank.type_ii(np.arange(256), np.full(2, lit), np.full(2, active))
            out += [(lit, active, s, int(t)) for s, t in enumerate(bank.ta[:, 0])]
    return spark.createDataFrame(out, "present boolean, active boolean, state int, after int")


def training_firing(spark, d):
    """Which clauses of two literals' counters fire, in training and in use."""
    states = np.array([(a, b) for a in (0, 127, 128, 255) for b in (0, 127, 128, 255)], np.uint8)
    out = []
    for bit in (0, 1):
        bank, lit = _bank(states), kernels.literals(np.array([bit]))
        for training in (True, False):
            out += [(int(a), int(b), bit, training, bool(f)) for (a, b), f in zip(states, bank.fires(lit, training=training))]
    return spark.createDataFrame(out, "positive int, negative int, bit int, training boolean, fires boolean")


def split_mix(spark, d):
    """The first numbers of streams of several seeds, in decimal."""
    out = []
    for seed in (0, 1, 42, (1 << 64) - 1):
        g = SplitMix64(seed)
        out += [(str(seed), k, str(g.next())) for k in range(4)]
    return spark.createDataFrame(out, "seed string, k int, value string")


_ENTRIES = [model_vanilla, model_accuracy, model_coalesced, model_composite, model_convolution_1d, model_convolution_2d, model_regressor, model_regressor_errors, model_autoencoder, model_tables, model_weights, top_indicators, first_rules, growth_of_models, training_type_i, training_type_ii, training_firing, split_mix]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ENTRIES}

_R = f"r as (select * from (values {Q._values(Q.RULES)}) as x(output, clause, feature, negated))"
_W = f"w as (select * from (values {Q._values(Q.WEIGHTS)}) as x(output, clause, weight))"
_GOLDEN, _ALL = 0x9E3779B97F4A7C15, 1 << 64
ORACLE: dict[str, str] = {
    "model_vanilla": Q.ORACLE["vanilla_scores"],
    "model_accuracy": Q.ORACLE["vanilla_accuracy"],
    "model_coalesced": Q.ORACLE["coalesced_predict"],
    "model_composite": Q.ORACLE["composite_predict"],
    "model_convolution_1d": Q.ORACLE["convolution_1d"],
    "model_convolution_2d": Q.ORACLE["convolution_2d"],
    "model_regressor": Q.ORACLE["regression_predict"],
    "model_regressor_errors": Q.ORACLE["regression_errors"],
    "model_autoencoder": Q.ORACLE["reconstruction_errors"],
    "model_tables": f"with {_R}, {_W}, t as (select output, clause, count(*) as n, string_agg(case when negated then '-' else '' end || cast(feature as varchar), ' ' order by feature, negated) as rule from r group by output, clause) select output, clause, weight, clause % 2 = 0 as positive, coalesce(n, 0) as n, coalesce(rule, '') as rule, '9/4/{Q.THRESHOLD}/2/1/1/9' as shape from w left join t using (output, clause)",
    "model_weights": f"with {_R}, {_W} select output, clause, feature, negated, 128 as state, case when clause % 2 = 0 then weight else -weight end as weight from r join w using (output, clause)",
    "top_indicators": f"with {_R} select feature, count(*) as n from r where not negated group by feature order by n desc, feature limit 4",
    "first_rules": f"with {_R}, t as (select output, clause, cast(count(*) as integer) as n_literals, string_agg(case when negated then '¬' else '' end || 'x' || cast(feature as varchar), ' ∧ ' order by feature, negated) as rule from r group by output, clause) select * from t where n_literals <= 1 order by output, clause limit 3",
    "growth_of_models": f"with c as (select c as clause, i as literal, i % 11 as f, i >= 11 as neg from range(4) a(c), range(22) b(i)), r as (select * from (values {Q._values(_SHARED)}) as x(output, clause, feature, negated)) select cast(c.clause as integer) as clause, cast(literal as integer) as literal, case when exists (select 1 from r where r.clause = c.clause and feature = f and negated = neg) then 128 else 127 end as state from c",
    "training_type_i": """with g as (select * from (values (true), (false)) a(boost), (values (true), (false)) b(fired), (values (true), (false)) c(present), (values (true), (false)) e(drawn), (select unnest(range(256)) as state)),
     u as (select *, fired and present and (boost or drawn) and state < 255 as up, drawn and (not fired or not present) and state > 0 and state < 255 as down from g)
     select boost, fired, present, drawn, cast(state as integer) as state, cast(state + cast(up as integer) - cast(down as integer) as integer) as after from u""",
    "training_type_ii": "select present, active, cast(state as integer) as state, cast(state + cast(not present and active and state > 0 and state < 128 as integer) as integer) as after from (values (true), (false)) a(present), (values (true), (false)) b(active), (select unnest(range(256)) as state)",
    "training_firing": "select p as positive, q as negative, bit, training, (p < 128 or bit = 1) and (q < 128 or bit = 0) and (training or p >= 128 or q >= 128) as fires from (values (0), (127), (128), (255)) a(p), (values (0), (127), (128), (255)) b(q), (values (0), (1)) c(bit), (values (true), (false)) e(training)",
    "split_mix": f"""with s as (select seed, k, (seed + {_GOLDEN}::uhugeint * (k + 2)::uhugeint) % {_ALL}::uhugeint as z from (select unnest([0::uhugeint, 1::uhugeint, 42::uhugeint, {_ALL - 1}::uhugeint]) as seed), (select unnest(range(4)) as k)),
     a as (select seed, k, (xor(z, z >> 30) * {0xBF58476D1CE4E5B9}::uhugeint) % {_ALL}::uhugeint as y from s), b as (select seed, k, (xor(y, y >> 27) * {0x94D049BB133111EB}::uhugeint) % {_ALL}::uhugeint as x from a)
     select cast(seed as varchar) as seed, cast(k as integer) as k, cast(xor(x, x >> 31) as varchar) as value from b""",
}
