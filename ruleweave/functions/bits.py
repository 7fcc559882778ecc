"""Expressions over Boolean features and literals.

A row's features are `bits array<tinyint>`. Literal l below F says that feature l
is 1, literal F + l that it is 0; `literals` lists the true ones. Rules hold
(feature, negated) rather than literal numbers, so they survive a growth of F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def saturating(value: Column, step: int, top: int) -> Column:
    """A counter in 0..top after a step."""
    return clamp(value + step, 0, top)


def as_bits(values: Column) -> Column:
    """0/1 from any numbers: what isn't zero is one."""
    return F.transform(values, lambda v: (v != 0).cast("tinyint"))


def thermometer(value: Column, thresholds: Column) -> Column:
    """One bit a threshold: value > threshold. NaN and null exceed nothing."""
    return F.transform(thresholds, lambda t: F.coalesce((~F.isnan(value) & (value > t)).cast("tinyint"), F.lit(0).cast("tinyint")))


def count_thermometer(count: Column, thresholds: list[int]) -> Column:
    """One bit a threshold: count >= threshold."""
    return F.array(*[(count >= t).cast("tinyint") for t in thresholds])


def literals(bits: Column) -> Column:
    """Numbers of the true literals, ascending."""
    n = F.size(bits)
    positive = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(bits, i) != 0)
    negative = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(bits, i) == 0), lambda i: i + n)
    return F.when(n > 0, F.concat(positive, negative)).otherwise(F.array().cast("array<int>"))


def words_for(n_bits: int) -> int:
    return -(-n_bits // 64)


def pack(bits: Column, n_features: int) -> Column:
    """Literals as words of 64 bits: bit i is feature i, bit F + i its negation. Words are signed; bit 63 is the sign."""
    def word(w: int) -> Column:
        total = F.lit(0).cast("bigint")
        for at in range(64 * w, min(64 * (w + 1), 2 * n_features)):
            bit = F.get(bits, F.lit(at % n_features)) != 0
            bit = bit if at < n_features else ~bit
            total = total.bitwiseOR(F.when(bit, F.shiftleft(F.lit(1).cast("bigint"), at % 64)).otherwise(F.lit(0).cast("bigint")))
        return total

    return F.array(*[word(w) for w in range(words_for(2 * n_features))])


def patches_1d(bits: Column, n_features: int, kernel: int, stride: int = 1) -> Column:
    """Windows of `kernel` features, `stride` apart."""
    if not 0 < kernel <= n_features or stride < 1:
        raise ValueError("a kernel must fit and a stride be positive")
    return F.transform(F.sequence(F.lit(0), F.lit((n_features - kernel) // stride)), lambda p: F.slice(bits, p * stride + 1, kernel))


def patches_2d(bits: Column, shape: tuple[int, int], kernel: tuple[int, int], stride: int = 1) -> Column:
    """Rectangles of a row-major image, row by row."""
    (rows, columns), (high, wide) = shape, kernel
    if not (0 < high <= rows and 0 < wide <= columns and stride >= 1):
        raise ValueError("a kernel must fit and a stride be positive")
    down, across = (rows - high) // stride + 1, (columns - wide) // stride + 1

    def patch(p: Column) -> Column:
        top, left = F.floor(p / across).cast("int") * stride, (p % across) * stride
        return F.flatten(F.array(*[F.slice(bits, (top + r) * columns + left + 1, wide) for r in range(high)]))

    return F.transform(F.sequence(F.lit(0), F.lit(down * across - 1)), patch)


def fires(included: Column, true_literals: Column, training: bool = False) -> Column:
    """Whether no included literal is absent. A clause that includes nothing fires in training only."""
    all_there = F.size(F.array_except(included, true_literals)) == 0
    return all_there if training else all_there & (F.size(included) > 0)


def first_blocking(included: Column, true_literals: Column) -> Column:
    """The smallest included literal that is absent; null if none is."""
    return F.array_min(F.array_except(included, true_literals))


def render_rule(rule: Column, names: Column | None = None) -> Column:
    """`x0 ∧ ¬x3` of an array of (feature, negated), or with names by feature; `(empty)` if it has none."""
    def term(t: Column) -> Column:
        name = F.concat(F.lit("x"), t["feature"].cast("string")) if names is None else F.get(names, t["feature"])
        return F.concat(F.when(t["negated"], F.lit("¬")).otherwise(F.lit("")), name)

    return F.when(F.size(rule) == 0, "(empty)").otherwise(F.array_join(F.transform(F.array_sort(rule), term), " ∧ "))
