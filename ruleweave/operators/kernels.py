"""Training kernels: numpy state machines of one unit (a class, an output, a member or a shared bank).

A unit sees samples one after another, as rule learning needs; units are
independent, so Spark trains them in parallel (see ruleweave.plans.models).
Counters are uint8; a literal is included when its counter is `half` or more.
`top` resists every decrement of Type I, zero resists Type II alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Config:
    n_features: int
    clauses: int
    threshold: int
    s: float
    state_bits: int = 8
    boost: bool = True
    seed: int = 0
    max_included: int | None = None
    clause_drop: float = 0.0
    literal_drop: float = 0.0
    type_iii: float | None = None
    class_weights: tuple[float, ...] | None = None
    focused: bool = False
    kernel: tuple[int, ...] = ()
    shape: tuple[int, int] = ()
    stride: int = 1

    def __post_init__(self) -> None:
        if self.clauses < 1 or self.threshold < 1 or self.s <= 1 or not 2 <= self.state_bits <= 8 or self.n_features < 1:
            raise ValueError("clauses, threshold and features must be positive, s above 1, state_bits from 2 to 8")
        if not (0 <= self.clause_drop < 1 and 0 <= self.literal_drop < 1) or (self.type_iii is not None and self.type_iii <= 1):
            raise ValueError("dropout must be in [0, 1) and the Type III parameter above 1")
        if self.class_weights is not None and min(self.class_weights) <= 0:
            raise ValueError("class weights must be positive")

    @property
    def half(self) -> int:
        return 1 << (self.state_bits - 1)

    @property
    def top(self) -> int:
        return (1 << self.state_bits) - 1

    @property
    def width(self) -> int:
        """Features that a clause sees: those of a patch, or all."""
        return int(np.prod(self.kernel)) if self.kernel else self.n_features


def literals(bits: np.ndarray) -> np.ndarray:
    """Truth of each literal, features first, along the last axis."""
    return np.concatenate([bits != 0, bits == 0], axis=-1)


def patches(bits: np.ndarray, config: Config) -> np.ndarray:
    """(patch, feature) of one row."""
    if len(config.kernel) == 1:
        k = config.kernel[0]
        return np.stack([bits[p : p + k] for p in range(0, config.n_features - k + 1, config.stride)])
    (rows, columns), (high, wide) = config.shape, config.kernel
    image = bits.reshape(rows, columns)
    return np.stack([image[r : r + high, c : c + wide].reshape(-1) for r in range(0, rows - high + 1, config.stride) for c in range(0, columns - wide + 1, config.stride)])


class Bank:
    """Counters of clauses over literals."""

    def __init__(self, config: Config, generator: np.random.Generator, coin: bool = True):
        self.config = config
        shape = (config.clauses, 2 * config.width)
        self.ta = np.full(shape, config.half - 1, np.uint8)
        if coin:
            self.ta += generator.integers(0, 2, shape, dtype=np.uint8)
        self.gone = np.zeros(shape, bool) if not coin else None
        if config.type_iii is not None:
            self.ind = np.full(shape, config.half, np.uint8)
            self.cat = np.zeros(shape, bool)
        self.refresh(slice(None))

    def refresh(self, rows) -> None:
        """Take up changed counters of rows: which literals are included, one byte each and eight to a byte."""
        now = self.ta[rows] >= self.config.half
        if isinstance(rows, slice):
            self.included = now
            self.words = np.zeros((len(now), -(-now.shape[1] // 64)), np.uint64)
        else:
            self.included[rows] = now
        self.words[rows] = self._words(now)

    def _words(self, flags: np.ndarray) -> np.ndarray:
        """Flags along the last axis as words of 64 bits."""
        packed = np.packbits(flags, axis=-1)
        short = -packed.shape[-1] % 8
        if short:
            packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
        return np.ascontiguousarray(packed).view(np.uint64)

    def fires(self, lit: np.ndarray, active: np.ndarray | None = None, training: bool = True) -> np.ndarray:
        """Clauses of which no included, active literal is absent; those that include nothing fire in training only."""
        absent = ~lit if active is None else ~lit & active
        fired = ~(self.words & self._words(absent)).any(axis=1)
        return fired if training else fired & self.words.any(axis=1)

    def fires_by_patch(self, lit: np.ndarray, active: np.ndarray | None = None, training: bool = True) -> np.ndarray:
        """(clause, patch)."""
        absent = ~lit if active is None else ~lit & active
        fired = (self.included.astype(np.float32) @ absent.T.astype(np.float32)) == 0
        return fired if training else fired & self.included.any(axis=1)[:, None]

    def type_i(self, rows: np.ndarray, fired: np.ndarray, lit: np.ndarray, active: np.ndarray, inv: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Recognise: rows that fired and may include more strengthen what is present; all others weaken. Returns the former."""
        room, top = self.config.max_included, self.config.top
        grows = fired if room is None else fired & (self.included[rows].sum(axis=1) < room)
        present = lit & active & (True if self.config.boost else keep)
        ta, one = self.ta[rows], grows[:, None]
        below = ta < top
        down = np.where(one, ~lit & active & inv, active & inv) & below & (ta > 0)
        up = one & present & below
        ta -= down.view(np.uint8)
        ta += up.view(np.uint8)
        self.ta[rows] = ta
        self.refresh(rows)
        return grows

    def type_ii(self, rows: np.ndarray, lit: np.ndarray, active: np.ndarray) -> None:
        """Reject: clauses that fired move absent, excluded literals towards inclusion."""
        ta = self.ta[rows]
        ta += (~lit & active & (ta > 0) & (ta < self.config.half)).view(np.uint8)
        self.ta[rows] = ta
        self.refresh(rows)

    def type_iii(self, rows: np.ndarray, fired: np.ndarray, target: bool, lit: np.ndarray, active: np.ndarray, p: float, generator: np.random.Generator) -> None:
        """Indicators of literals that matter; those that fall low lose their counters."""
        c, d = self.config, self.config.type_iii
        lit = np.broadcast_to(lit, (len(rows), self.ta.shape[1]))
        ind, cat = self.ind[rows].astype(np.int16), self.cat[rows].copy()
        rises = generator.random(len(rows)) <= 1 - 1 / d if target else np.zeros(len(rows), bool)
        on = fired[:, None]
        ind = np.where(on & rises[:, None] & active & cat & lit, np.minimum(ind + 1, c.top), ind)
        ind = np.where(on & active & ~cat & lit, np.maximum(ind - 1, 0), ind)
        blocked = self.included[rows] & ~lit & active
        first = blocked.argmax(axis=1)
        some = ~fired & blocked.any(axis=1)
        was = cat[np.arange(len(rows)), first]
        cat = np.where(on, ~cat if target else np.ones_like(cat), cat)
        at = np.nonzero(some)[0]
        cat[at, first[at]] = np.where(was[at], not target, True)
        falls = (generator.random(len(rows)) <= p)[:, None] & active & (ind < c.half)
        self.ta[rows] -= (falls & (self.ta[rows] > 0)).astype(np.uint8)
        self.ind[rows], self.cat[rows] = ind.astype(np.uint8), cat
        self.refresh(rows)

    def sparse_type_i(self, rows: np.ndarray, fired: np.ndarray, lit: np.ndarray, active: np.ndarray, generator: np.random.Generator) -> None:
        """Type I of sparse clauses: draws per literal and clause, only absent literals weaken, and an excluded literal that would fall below 1 is removed for good."""
        c = self.config
        ta, gone = self.ta[rows].astype(np.int16), self.gone[rows]
        lit = np.broadcast_to(lit, ta.shape)
        draw = generator.random(ta.shape)
        if c.max_included is not None:  # a full clause strengthens nothing
            fired = fired & (self.included[rows].sum(axis=1) < c.max_included)
        up = fired[:, None] & lit & active & ~gone & (True if c.boost else draw < (c.s - 1) / c.s)
        if c.max_included is not None:  # promotions stop at the limit, in order of the literals
            promoted = up & (ta == c.half - 1)
            room = np.maximum(c.max_included - self.included[rows].sum(axis=1), 0)
            up &= ~(promoted & (np.cumsum(promoted, axis=1) > room[:, None]))
        down = ~lit & active & ~gone & (draw < 1 / c.s) & (ta < c.top)
        removed = down & (ta < c.half) & (ta <= 1)
        self.gone[rows] = gone | removed
        self.ta[rows] = np.where(up, np.minimum(ta + 1, c.top), np.where(down, np.maximum(ta - 1, 0), ta)).astype(np.uint8)
        self.refresh(rows)

    def grow(self, n_features: int) -> None:
        """New features' literals begin just excluded; negations move behind them."""
        old = self.ta.shape[1] // 2
        if n_features < old:
            raise ValueError("features can't shrink")

        def wider(a: np.ndarray, value) -> np.ndarray:
            new = np.full((len(a), n_features - old), value, a.dtype)
            return np.concatenate([a[:, :old], new, a[:, old:], new], axis=1)

        self.ta = wider(self.ta, self.config.half - 1)
        if self.gone is not None:
            self.gone = wider(self.gone, False)
        if self.config.type_iii is not None:
            self.ind, self.cat = wider(self.ind, self.config.half), wider(self.cat, False)
        self.refresh(slice(None))


def _masks(config: Config, generator: np.random.Generator, width: int) -> tuple[np.ndarray, np.ndarray]:
    return generator.random(width) < 1 / config.s, generator.random(width) < (config.s - 1) / config.s


class VotingUnit:
    """A class (or an autoencoder's output): clauses with weights of 1 or more, even ones for, odd ones against."""

    def __init__(self, config: Config, unit: int = 0, sparse: bool = False):
        self.config, self.unit, self.sparse = config, unit, sparse
        self.generator = np.random.default_rng((config.seed, unit))
        self.bank = Bank(config, self.generator, coin=not sparse)
        self.weight = np.ones(config.clauses, np.int32)
        self.sign = np.where(np.arange(config.clauses) % 2 == 0, 1, -1)

    def _lit(self, bits: np.ndarray) -> np.ndarray:
        return literals(patches(bits, self.config) if self.config.kernel else bits)

    def votes(self, bits: np.ndarray) -> int:
        """Unclamped votes under inference rules."""
        lit = self._lit(bits)
        fired = self.bank.fires_by_patch(lit, training=False).any(axis=1) if lit.ndim == 2 else self.bank.fires(lit, training=False)
        return int((self.sign * self.weight)[fired].sum())

    def fired(self, bits: np.ndarray) -> np.ndarray:
        lit = self._lit(bits)
        return self.bank.fires_by_patch(lit, training=False).any(axis=1) if lit.ndim == 2 else self.bank.fires(lit, training=False)

    def update(self, bits: np.ndarray, target: bool, active: np.ndarray | None = None) -> None:
        c, g, bank = self.config, self.generator, self.bank
        lit = self._lit(bits)
        width = lit.shape[-1]
        active = np.ones(width, bool) if active is None else active
        if c.literal_drop:
            active = active & (g.random(width) >= c.literal_drop)
        kept = g.random(c.clauses) >= c.clause_drop if c.clause_drop else np.ones(c.clauses, bool)
        if lit.ndim == 2:
            by_patch = bank.fires_by_patch(lit, active)
            fired = by_patch.any(axis=1)
            # A firing patch, uniformly; patch 0 where none fires.
            chosen = np.where(fired, (by_patch * (g.random(by_patch.shape) + 1e-9)).argmax(axis=1), 0)
            own = lit[chosen]
        else:
            fired, own = bank.fires(lit, active), None
        t = c.threshold
        v = int(np.clip((self.sign * self.weight)[fired].sum(), -t, t))  # dropped clauses vote, but don't learn
        weight = c.class_weights[self.unit] if c.class_weights else 1.0
        p = min(1.0, (t - v if target else t + v) / (2 * t) * weight)
        inv, keep = _masks(c, g, width)
        gated = kept & (g.random(c.clauses) <= p)
        first = gated & ((self.sign > 0) == target)
        rows = np.nonzero(first)[0]
        if len(rows):
            here = lit if own is None else own[rows]
            if self.sparse:
                bank.sparse_type_i(rows, fired[rows], here, active, g)
                grows = fired[rows]
            else:
                grows = bank.type_i(rows, fired[rows], here, active, inv, keep)
            self.weight[rows[grows]] = np.minimum(self.weight[rows[grows]] + 1, t)
        rows = np.nonzero(gated & ~first & fired)[0]
        if len(rows):
            bank.type_ii(rows, lit if own is None else own[rows], active)
            self.weight[rows] = np.maximum(self.weight[rows] - 1, 1)
        if c.type_iii is not None:
            rows = np.nonzero(kept)[0]
            here = lit if own is None else own[rows]
            # Firing is taken anew, after the feedback above.
            bank.type_iii(rows, ~(bank.included[rows] & ~here & active).any(axis=1), target, here, active, p, g)


class RegressionUnit:
    """One bank with weights of 0 or more; the prediction is their clamped sum."""

    def __init__(self, config: Config, unit: int = 0):
        self.config = config
        self.generator = np.random.default_rng((config.seed, unit))
        self.bank = Bank(config, self.generator)
        self.bank.ta[:] = config.half - 1
        self.bank.refresh(slice(None))
        self.weight = np.ones(config.clauses, np.int32)

    def predict(self, bits: np.ndarray) -> float:
        fired = self.bank.fires(literals(bits), training=False)
        return float(np.clip(self.weight[fired].sum(), 0, self.config.threshold))

    def update(self, bits: np.ndarray, target: float) -> None:
        c, g, lit = self.config, self.generator, literals(bits)
        v = self.predict(bits)
        p = min(1.0, ((v - target) / c.threshold) ** 2)
        if p < np.finfo(float).eps:
            return
        active = g.random(len(lit)) >= c.literal_drop if c.literal_drop else np.ones(len(lit), bool)
        kept = g.random(c.clauses) >= c.clause_drop if c.clause_drop else np.ones(c.clauses, bool)
        fired = self.bank.fires(lit, active)
        inv, keep = _masks(c, g, len(lit))
        gated = kept & (g.random(c.clauses) <= p)
        if target > v:
            rows = np.nonzero(gated)[0]
            if len(rows):
                grows = self.bank.type_i(rows, fired[rows], lit, active, inv, keep)
                self.weight[rows[grows]] = np.minimum(self.weight[rows[grows]] + 1, c.threshold)
        else:
            rows = np.nonzero(gated & fired)[0]
            if len(rows):
                self.bank.type_ii(rows, lit, active)
                self.weight[rows] = np.maximum(self.weight[rows] - 1, 0)
        if c.type_iii is not None:
            rows = np.nonzero(kept)[0]
            self.bank.type_iii(rows, fired[rows], target > v, lit, active, p, g)


class SharedUnit:
    """A bank that all outputs share through signed weights."""

    def __init__(self, config: Config, outputs: int, unit: int = 0):
        self.config, self.outputs = config, outputs
        self.generator = np.random.default_rng((config.seed, unit))
        self.bank = Bank(config, self.generator)
        self.weight = np.random.default_rng((config.seed, 0x57, unit)).choice(np.array([-1, 1], np.int32), (outputs, config.clauses)).astype(np.int32)

    def votes(self, bits: np.ndarray) -> np.ndarray:
        return self.weight[:, self.bank.fires(literals(bits), training=False)].sum(axis=1)

    def feedback(self, lit: np.ndarray, output: int, target: bool, fired: np.ndarray, kept: np.ndarray, active: np.ndarray, total: int) -> None:
        c, g = self.config, self.generator
        t = c.threshold
        v = int(np.clip(total, -t, t))
        p = (t - v if target else t + v) / (2 * t)
        inv, keep = _masks(c, g, len(lit))
        first = (self.weight[output] >= 0) == target
        gated = kept & (g.random(c.clauses) <= p)
        rows = np.nonzero(gated & first)[0]
        if len(rows):
            self.bank.type_i(rows, fired[rows], lit, active, inv, keep)
        rows = np.nonzero(gated & ~first & fired)[0]
        if len(rows):
            self.bank.type_ii(rows, lit, active)
        moved = kept & fired & (g.random(c.clauses) <= p)
        self.weight[output, moved] += 1 if target else -1
        if c.type_iii is not None:
            rows = np.nonzero(kept)[0]
            self.bank.type_iii(rows, fired[rows], target, lit, active, p, g)

    def _drops(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        c, g = self.config, self.generator
        active = g.random(width) >= c.literal_drop if c.literal_drop else np.ones(width, bool)
        return active, g.random(c.clauses) >= c.clause_drop if c.clause_drop else np.ones(c.clauses, bool)

    def update(self, bits: np.ndarray, label: int) -> None:
        """Two passes, for the label and for another class, over clause outputs taken once."""
        c, g, lit = self.config, self.generator, literals(bits)
        active, kept = self._drops(len(lit))
        fired = self.bank.fires(lit, active)
        sums = self.weight[:, fired & kept].sum(axis=1)
        others = np.array([k for k in range(self.outputs) if k != label])
        if c.focused:
            chance = np.clip((c.threshold + sums[others]) / (2 * c.threshold), 0, 1)
            other = int(g.choice(others, p=chance / chance.sum())) if chance.sum() > 0 else int(g.choice(others))
        else:
            other = int(g.choice(others))
        self.feedback(lit, label, True, fired, kept, active, self.weight[label, fired & kept].sum())
        self.feedback(lit, other, False, fired, kept, active, self.weight[other, fired & kept].sum())

    def update_outputs(self, bits: np.ndarray) -> None:
        """Autoencoding: each output is its bit, with its own literals masked, against the bank as it stands."""
        lit, n = literals(bits), self.config.n_features
        active, kept = self._drops(len(lit))
        for o in range(n):
            own = active.copy()
            own[[o, o + n]] = False
            fired = self.bank.fires(lit, own)
            self.feedback(lit, o, bool(bits[o]), fired, kept, own, self.weight[o, fired].sum())


class EncoderUnit(VotingUnit):
    """One output of an autoencoder with a bank of its own."""

    def update_output(self, bits: np.ndarray) -> None:
        own = np.ones(2 * self.config.n_features, bool)
        own[[self.unit, self.unit + self.config.n_features]] = False
        self.update(bits, bool(bits[self.unit]), own)


def merge(units: list) -> object:
    """The rounded mean of replicas' counters and weights; weights of voting units stay in 1..threshold."""
    out, k = units[0], len(units)
    out.bank.ta = ((sum(u.bank.ta.astype(np.int64) for u in units) + k // 2) // k).astype(np.uint8)
    total = sum(u.weight.astype(np.int64) for u in units)
    mean = np.sign(total) * ((np.abs(total) + k // 2) // k)
    out.weight = (np.clip(mean, 1, out.config.threshold) if isinstance(out, VotingUnit) else mean).astype(np.int32)
    out.bank.refresh(slice(None))
    return out
