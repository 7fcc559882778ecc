"""Rule evaluation as DataFrame plans.

Tables: samples (row_id, bits), clause_lits (output, clause, feature, negated; what
each clause includes), weights (output, clause, weight; signed). Clauses of a
shared bank have output -1 in clause_lits and one weight per output.

An output without a fired clause scores 0 and may win, so votes are completed
with every output. Ties go to the first output or to the last, by family.

Two ways give the same results. Rules of up to HELD literals and weights are one
expression on each row (scored_rows): one pass over the samples, no shuffle, no
row a literal. Larger models are evaluated by joins of literals with clauses.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.bits import clamp

SHARED = -1
#: Literals, and products of clauses and outputs, up to which a model is an expression.
HELD = 5_000


def _held(clause_lits: DataFrame, weights: DataFrame | None = None, n_outputs: int = 0) -> Column | None:
    """The clauses as one constant, array<struct<output, clause, on, off, w>>; None if they are too many. Reads at most HELD + 1 rows of a table."""
    lits = clause_lits.select("output", "clause", "feature", "negated").limit(HELD + 1).collect()
    given = [] if weights is None else weights.select("output", "clause", "weight").limit(HELD + 1).collect()
    clauses = sorted({(r["output"], r["clause"]) for r in lits})
    if max(len(lits), len(given), len(clauses) * max(1, n_outputs)) > HELD:
        return None
    held = {k: {"output": k[0], "clause": k[1], "on": [], "off": [], "w": [0] * n_outputs} for k in clauses}
    for r in lits:
        held[r["output"], r["clause"]]["off" if r["negated"] else "on"].append(r["feature"])
    for r in given:
        for name in ((r["output"], r["clause"]), (SHARED, r["clause"])):
            if name in held and 0 <= r["output"] < n_outputs:
                held[name]["w"][r["output"]] += r["weight"]
    return F.from_json(F.lit(json.dumps(list(held.values()))), "array<struct<output:int,clause:int,on:array<int>,off:array<int>,w:array<bigint>>>")


def _met(clause: Column, bits: Column) -> Column:
    return F.forall(clause["on"], lambda i: F.get(bits, i) != 0) & F.forall(clause["off"], lambda i: F.get(bits, i) == 0)


def scored_rows(samples: DataFrame, clause_lits: DataFrame, weights: DataFrame, n_outputs: int, threshold: int | None = None, last_wins: bool = False, patches: Column | None = None, bits: str = "bits") -> DataFrame:
    """samples, all columns, with votes and scores (by output; scores are clamped to the threshold, if there is one) and prediction.

    With patches, a clause fires if it does on some patch. Weights are signed.
    """
    clauses = _held(clause_lits, weights, n_outputs)
    if clauses is None:
        raise ValueError(f"the model has more than {HELD} literals or weights; use votes, scores and argmax")
    if patches is None:
        fires = lambda c: _met(c, F.col(bits))
    else:
        samples = samples.withColumn("__patches", patches)
        fires = lambda c: F.exists("__patches", lambda p: _met(c, p))
    none = F.array_repeat(F.lit(0).cast("bigint"), n_outputs)
    found = samples.withColumn("votes", F.aggregate(F.filter(clauses, fires), none, lambda total, c: F.zip_with(total, c["w"], lambda a, b: a + b)))
    found = found.withColumn("scores", F.col("votes") if threshold is None else F.transform("votes", lambda v: clamp(v, -threshold, threshold)))
    return found.withColumn("prediction", best_of(F.col("scores"), n_outputs, last_wins)).drop("__patches")


def best_of(values: Column, n: int, last_wins: bool = False) -> Column:
    """The place of the largest of n values; of equal ones, the first or the last."""
    best = F.array_max(values)
    return ((n - F.array_position(F.reverse(values), best)) if last_wins else F.array_position(values, best) - 1).cast("int")


def sample_literals(samples: DataFrame, key: str = "row_id", bits: str = "bits") -> DataFrame:
    """(key, feature, negated) of each true literal."""
    return samples.select(key, F.posexplode(bits).alias("feature", "value")).select(key, "feature", (F.col("value") == 0).alias("negated"))


def fired(samples: DataFrame, clause_lits: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keys, output, clause) of clauses of which every literal is true: by an expression on each row, or relational division of larger models.

    A clause that includes nothing has no row in clause_lits and never fires.
    """
    clauses = _held(clause_lits)
    if clauses is not None:
        met = samples.select(*keys, F.explode(F.filter(clauses, lambda c: _met(c, F.col("bits")))).alias("c"))
        return met.select(*keys, "c.output", "c.clause")
    needed = clause_lits.groupBy("output", "clause").agg(F.count("*").alias("needed"))
    rules = clause_lits.join(needed, ["output", "clause"])
    literals = samples.select(*keys, F.posexplode("bits").alias("feature", "value")).withColumn("negated", F.col("value") == 0)
    met = literals.join(rules, ["feature", "negated"]).groupBy(*keys, "output", "clause", "needed").agg(F.count("*").alias("met"))
    return met.where("met = needed").select(*keys, "output", "clause")


def fired_any_patch(samples: DataFrame, clause_lits: DataFrame, patches: Column) -> DataFrame:
    """(row_id, output, clause) of clauses that fire on some patch; a clause counts once."""
    each = samples.select("row_id", F.posexplode(patches).alias("patch", "bits"))
    return fired(each, clause_lits, ("row_id", "patch")).select("row_id", "output", "clause").distinct()


def votes(samples: DataFrame, firing: DataFrame, weights: DataFrame, n_outputs: int) -> DataFrame:
    """(row_id, output, votes): the sum of the weights of fired clauses, 0 where none fired."""
    shared = firing.where(F.col("output") == SHARED).select("row_id", "clause").join(weights, "clause")
    own = firing.where(F.col("output") != SHARED).join(weights, ["output", "clause"])
    summed = own.select("row_id", "output", "weight").unionByName(shared.select("row_id", "output", "weight")).groupBy("row_id", "output").agg(F.sum("weight").alias("votes"))
    every = samples.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(n_outputs - 1))).alias("output"))
    return every.join(summed, ["row_id", "output"], "left").select("row_id", "output", F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"))


def scores(voted: DataFrame, threshold: int) -> DataFrame:
    """(row_id, output, score): votes clamped to the threshold."""
    return voted.select("row_id", "output", clamp(F.col("votes"), -threshold, threshold).alias("score"))


def argmax(scored: DataFrame, value: str = "score", last_wins: bool = False) -> DataFrame:
    """(row_id, prediction): the output with the largest value.

    One aggregate without a sort: of equal values the struct's second field
    decides, which is the output or its negative.
    """
    tie = F.col("output") if last_wins else -F.col("output")
    best = scored.groupBy("row_id").agg(F.max(F.struct(F.col(value).alias("v"), tie.alias("tie"))).alias("best"))
    return best.select("row_id", (F.col("best.tie") if last_wins else -F.col("best.tie")).cast("int").alias("prediction"))


def parity_weights(clauses: DataFrame) -> DataFrame:
    """Signed weights of clauses (output, clause, weight) whose even ones vote for and odd ones against their output."""
    return clauses.select("output", "clause", F.when(F.col("clause") % 2 == 0, F.col("weight")).otherwise(-F.col("weight")).alias("weight"))


def _small(clause_lits: DataFrame, weights: DataFrame, n_outputs: int) -> bool:
    return _held(clause_lits, weights, n_outputs) is not None


def predict_vanilla(samples: DataFrame, clause_lits: DataFrame, clauses: DataFrame, n_outputs: int, threshold: int) -> DataFrame:
    """(row_id, prediction): argmax of clamped scores; the first output wins ties. Sparse models evaluate alike."""
    weights = parity_weights(clauses)
    if _small(clause_lits, weights, n_outputs):
        return scored_rows(samples, clause_lits, weights, n_outputs, threshold).select("row_id", "prediction")
    return argmax(scores(votes(samples, fired(samples, clause_lits), weights, n_outputs), threshold))


def predict_coalesced(samples: DataFrame, clause_lits: DataFrame, weights: DataFrame, n_outputs: int) -> DataFrame:
    """(row_id, prediction): argmax of unclamped votes of a shared bank; the first output wins ties."""
    if _small(clause_lits, weights, n_outputs):
        return scored_rows(samples, clause_lits, weights, n_outputs).select("row_id", "prediction")
    return argmax(votes(samples, fired(samples, clause_lits), weights, n_outputs), "votes")


def predict_convolutional(samples: DataFrame, clause_lits: DataFrame, clauses: DataFrame, n_outputs: int, threshold: int, patches: Column) -> DataFrame:
    """(row_id, prediction): a clause fires if it does on some patch; the last output wins ties."""
    weights = parity_weights(clauses)
    if _small(clause_lits, weights, n_outputs):
        return scored_rows(samples, clause_lits, weights, n_outputs, threshold, True, patches).select("row_id", "prediction")
    return argmax(scores(votes(samples, fired_any_patch(samples, clause_lits, patches), weights, n_outputs), threshold), last_wins=True)


def composite_rows(samples: DataFrame, members: list[tuple[DataFrame, DataFrame, int]], n_outputs: int) -> DataFrame:
    """samples with scores and prediction of members (clause_lits, signed weights, threshold) that vote with clamped scores; the last output wins ties."""
    found = samples
    for i, (lits, weights, threshold) in enumerate(members):
        found = scored_rows(found, lits, weights, n_outputs, threshold).withColumnRenamed("scores", f"__member{i}").drop("votes", "prediction")
    total = F.col("__member0")
    for i in range(1, len(members)):
        total = F.zip_with(total, F.col(f"__member{i}"), lambda a, b: a + b)
    found = found.withColumn("scores", total).drop(*[f"__member{i}" for i in range(len(members))])
    return found.withColumn("prediction", best_of(F.col("scores"), n_outputs, last_wins=True))


def composite_scores(members: list[DataFrame]) -> DataFrame:
    """Sum of the members' clamped scores."""
    every = members[0]
    for m in members[1:]:
        every = every.unionByName(m)
    return every.groupBy("row_id", "output").agg(F.sum("score").alias("score"))


def predict_composite(members: list[DataFrame]) -> DataFrame:
    """Argmax of the summed scores; the last output wins ties."""
    return argmax(composite_scores(members), last_wins=True)


def predict_regression(samples: DataFrame, clause_lits: DataFrame, weights: DataFrame, threshold: int) -> DataFrame:
    """(row_id, prediction): the sum of fired weights, clamped to 0..threshold."""
    if _small(clause_lits, weights, 1):
        voted = scored_rows(samples, clause_lits, weights, 1).select("row_id", F.get("votes", F.lit(0)).alias("votes"))
    else:
        voted = votes(samples, fired(samples, clause_lits), weights, 1)
    return voted.select("row_id", clamp(F.col("votes"), 0, threshold).cast("double").alias("prediction"))


def reconstruct(samples: DataFrame, clause_lits: DataFrame, weights: DataFrame, n_outputs: int) -> DataFrame:
    """(row_id, output, bit): 1 where the unclamped votes are positive."""
    if _small(clause_lits, weights, n_outputs):
        voted = scored_rows(samples, clause_lits, weights, n_outputs).select("row_id", F.posexplode("votes").alias("output", "votes"))
    else:
        voted = votes(samples, fired(samples, clause_lits), weights, n_outputs)
    return voted.select("row_id", "output", (F.col("votes") > 0).cast("int").alias("bit"))
