"""Inspection of models as tables: rules, literal frequencies, absorbed counters, growth, replica merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.bits import render_rule


def rules(clause_lits: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(output, clause, n_literals, rule) of clauses that include something; names is (feature, name)."""
    named = clause_lits.withColumn("name", F.concat(F.lit("x"), F.col("feature").cast("string")))
    if names is not None:
        named = clause_lits.join(F.broadcast(names), "feature", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("x"), F.col("feature").cast("string"))))
    term = F.concat(F.when(F.col("negated"), "¬").otherwise(""), F.col("name"))
    gathered = named.groupBy("output", "clause").agg(F.array_sort(F.collect_list(F.struct("feature", "negated", term.alias("term")))).alias("terms"))
    return gathered.select("output", "clause", F.size("terms").alias("n_literals"), F.array_join(F.col("terms.term"), " ∧ ").alias("rule"))


def literal_frequency(clause_lits: DataFrame) -> DataFrame:
    """(feature, n): clauses that include a feature, negated or not."""
    return clause_lits.groupBy("feature").agg(F.count("*").alias("n"))


def first_rules(clause_lits: DataFrame, n: int, longest: int | None = None) -> DataFrame:
    """The first n rules by output and clause, of those with `longest` literals at most."""
    found = rules(clause_lits)
    return (found if longest is None else found.where(F.col("n_literals") <= longest)).orderBy("output", "clause").limit(n)


def top_indicators(clause_lits: DataFrame, n: int = 4) -> DataFrame:
    """(feature, n) of the features that most clauses include unnegated; of equal counts, the smaller feature."""
    return literal_frequency(clause_lits.where(~F.col("negated"))).orderBy(F.desc("n"), "feature").limit(n)


def absorbed(counters: DataFrame, top: int) -> DataFrame:
    """(included, excluded): shares of counters (column state) at the top and at zero; null of an empty table."""
    return counters.agg(F.avg((F.col("state") == top).cast("double")).alias("included"), F.avg((F.col("state") == 0).cast("double")).alias("excluded"))


def mixed_polarity(weights: DataFrame) -> DataFrame:
    """(clause, mixed): whether a shared clause votes for some output and against another."""
    return weights.groupBy("clause").agg((F.bool_or(F.col("weight") > 0) & F.bool_or(F.col("weight") < 0)).alias("mixed"))


def clause_sizes(clause_lits: DataFrame, clauses: DataFrame) -> DataFrame:
    """(output, clause, n): included literals, 0 for empty clauses."""
    sizes = clause_lits.groupBy("output", "clause").agg(F.count("*").alias("n"))
    return clauses.select("output", "clause").join(sizes, ["output", "clause"], "left").select("output", "clause", F.coalesce("n", F.lit(0)).alias("n"))


def grow(counters: DataFrame, old: int, new: int, half: int) -> DataFrame:
    """Counters (output, clause, feature, negated, state) of a model that grew from old to new features.

    Literals are named by feature and sign, so what was learned keeps its place;
    the new ones begin just excluded.
    """
    if new < old:
        raise ValueError("features can't shrink")
    if new == old:
        return counters
    clauses = counters.select("output", "clause").distinct()
    added = clauses.withColumn("feature", F.explode(F.sequence(F.lit(old), F.lit(new - 1)))).withColumn("negated", F.explode(F.array(F.lit(False), F.lit(True))))
    return counters.unionByName(added.withColumn("state", F.lit(half - 1).cast(dict(counters.dtypes)["state"])))


def merge_replicas(cells: DataFrame, keys: list[str], value: str = "value", replicas: int = 1, signed: bool = False) -> DataFrame:
    """Rounded mean over replicas of each cell: (sum + k/2) div k, or the same away from zero for signed values."""
    total, half = F.sum(value), replicas // 2
    mean = F.expr(f"(sum({value}) + {half}) div {replicas}")
    if signed:
        mean = F.when(total >= 0, F.expr(f"(sum({value}) + {half}) div {replicas}")).otherwise(-F.expr(f"(-sum({value}) + {half}) div {replicas}"))
    return cells.groupBy(*keys).agg(mean.alias(value))


__all__ = ["absorbed", "clause_sizes", "first_rules", "grow", "literal_frequency", "merge_replicas", "mixed_polarity", "render_rule", "rules", "top_indicators"]
