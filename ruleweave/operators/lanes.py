"""Training of small voting units in lanes: the same steps and draws as VotingUnit.update, bit for bit, many times faster.

A small unit's arrays hold a few hundred counters, so numpy spends its time on
calls, not on counters. Here all counters of a unit are one int, a lane each,
and what a sample does to all of them takes some twenty operations on ints.
What does not depend on the state (draws, and which clauses a vote lets learn)
is made by numpy, a block of samples at a time.

A lane has the counter's bits and a guard bit above them; sets of literals are
guard bits. Lanes of a clause form a field, with a bit `empty` above all
inclusion bits. Weights are a second int, of shorter lanes.
"""

from __future__ import annotations

import sys

import numpy as np

BLOCK = 4096
#: Tables have an entry for each set of clauses, of features and of half the literals, gates one for each vote.
MOST_CLAUSES, MOST_FEATURES, MOST_THRESHOLD = 12, 12, 32


def fits(unit) -> bool:
    """Whether the unit is small and learns by Type I and II feedback alone, without drops, patches or limits."""
    c = unit.config
    small = 2 <= c.clauses <= MOST_CLAUSES and c.n_features <= MOST_FEATURES and c.threshold <= MOST_THRESHOLD
    plain = c.boost and not (unit.sparse or c.kernel or c.clause_drop or c.literal_drop) and c.type_iii is None and c.max_included is None
    return small and plain and 1 <= int(unit.weight.min()) and int(unit.weight.max()) <= c.threshold


def numbers(x: np.ndarray) -> np.ndarray:
    """Of each row, the number of its set of true features."""
    out = np.zeros(len(x), np.uint16)
    for j in range(x.shape[1]):
        out |= (x[:, j] != 0).astype(np.uint16) << np.uint16(j)
    return out


def _unions(parts: list[int]) -> list[int]:
    """Of each subset of the parts, by the bits of its number, the union."""
    out = [0]
    for part in parts:
        out += [s | part for s in out]
    return out


class Lanes:
    """A unit's state, taken from it at first and given back by `store`."""

    def __init__(self, unit):
        c = self.config = unit.config
        self.unit, self.bits, lane, k = unit, c.state_bits, c.state_bits + 1, 2 * c.n_features
        # An int's hash is its remainder by 2**period - 1: with fields one longer than a multiple of the period,
        # and `empty` at that multiple, the hash of all `empty` bits has clause c at bit c.
        period = sys.hash_info.modulus.bit_length()
        top = -(-(lane * k - 1) // period) * period
        self.at = [[clause * (top + 1) + lane * j for j in range(k)] for clause in range(c.clauses)]
        self.empty = sum(1 << clause * (top + 1) + top for clause in range(c.clauses))
        every = [1 << p + self.bits for row in self.at for p in row]
        self.guards = sum(every)
        self.ones = self.guards >> self.bits
        self.fields = _unions([sum(1 << p + self.bits for p in row) for row in self.at])
        literal = [sum(1 << row[j] + self.bits for row in self.at) for j in range(k)]
        self.low, self.high = _unions(literal[: k // 2]), _unions(literal[k // 2 :])
        present = [t | f for t, f in zip(self.low, reversed(self.high))]
        self.samples = [(p, self.guards ^ p, (self.guards ^ p) >> 1) for p in present]
        self.state = sum(int(v) << p for row, values in zip(self.at, unit.bank.ta) for p, v in zip(row, values))
        # Lanes at the top stay there, so no field has them.
        free = self.guards ^ (self.state + self.ones & self.guards)
        self.fields = [s & free for s in self.fields]
        # Weights: lanes that hold all votes, with sign, modulo 2**w - 1; the complement of a lane is its negative.
        t, against = c.threshold, [bool(s < 0) for s in unit.sign]
        self.w = w = (2 * c.clauses * t + 2).bit_length()
        self.wide = _unions([((1 << w) - 1) << w * i for i in range(c.clauses)])
        self.flip = _unions([((1 << w) - 1) << w * i if a else 0 for i, a in enumerate(against)])
        self.heads = _unions([1 << w * i + w - 1 for i in range(c.clauses)])
        self.weights = sum(int(v) << w * i for i, v in enumerate(unit.weight))
        self.mod = (1 << w) - 1
        votes = [r if r <= self.mod // 2 else r - self.mod for r in range(self.mod)]
        # The chance to learn rises with the clamped votes of a sample of another class, and with their negative of an own one.
        self.levels = [max(-t, min(t, v)) + t for v in votes], [t - max(-t, min(t, v)) for v in votes]
        self.against = sum(1 << i for i, a in enumerate(against) if a)
        self.class_weight = c.class_weights[unit.unit] if c.class_weights else 1.0
        self.chance = np.array([min(1.0, (t + v) / (2 * t) * self.class_weight) for v in range(-t, t + 1)])

    def train(self, rows: np.ndarray, targets: np.ndarray) -> None:
        """Samples one after another: the number of each one's set of true features, and whether it is the unit's own."""
        for i in range(0, len(rows), BLOCK):
            self._block(rows[i : i + BLOCK], targets[i : i + BLOCK])

    def _block(self, rows: np.ndarray, targets: np.ndarray) -> None:
        c, n, f = self.config, len(rows), self.config.n_features
        draws = self.unit.generator.random((n, 4 * f + c.clauses))
        weaken, place = draws[:, : 2 * f] < 1 / c.s, 1 << np.arange(f)
        gates = memoryview(self._gates(draws[:, 4 * f :]))
        # Names of this loop alone are quicker than attributes.
        samples, fields, low, high, wide, flip, heads, mod = self.samples, self.fields, self.low, self.high, self.wide, self.flip, self.heads, self.mod
        state, weights, empty, guards, ones, bits, head = self.state, self.weights, self.empty, self.guards, self.ones, self.bits, self.w - 1
        lanes, levels = heads[-1] >> head, [[n * v for v in level] for level in self.levels]
        nearly, above, lowest = guards - ones, lanes * ((1 << head) + c.threshold - 1), lanes * ((1 << head) - 2)
        free, due, stride = fields[-1], 0, c.half // 8 or 1
        near = ones * stride
        sides = self.against, len(fields) - 1 ^ self.against
        for i, row, target, a, b in zip(range(n), rows.tolist(), targets.tolist(), (weaken[:, :f] @ place).tolist(), (weaken[:, f:] @ place).tolist()):
            present, absent, blocking = samples[row]
            fired = hash(empty - (state & blocking) & empty)
            gated = gates[levels[target][((weights & wide[fired]) ^ flip[fired]) % mod] + i]
            if not gated:
                continue
            first = gated & sides[target]
            grows = first & fired
            rejects = (gated ^ first) & fired
            some = state + nearly & guards  # lanes above zero
            up, down = 0, fields[first ^ grows]
            if grows:
                grown = fields[grows]
                up, down = present & grown, down | absent & grown
                weights += (heads[grows] & above - weights) >> head
            if rejects:
                up |= absent & fields[rejects] & some
                weights -= (heads[rejects] & weights + lowest) >> head
            state += up - (down & some & (low[a] | high[b])) >> bits
            if i < due:
                continue
            full = state + ones & free
            if full:
                free ^= full
                fields[:] = [s & free for s in fields]
            # A step adds one at most: where all free lanes are `stride` below the top or more, fewer steps can't fill any.
            due = i if state + near & free else i + stride
        self.state, self.weights = state, weights

    def _gates(self, draws: np.ndarray) -> np.ndarray:
        """For each level and sample, the set of clauses whose draw lets them learn."""
        n, last, rises = len(draws), len(self.chance) - 1, np.append(self.chance, np.inf)
        out, column = np.zeros((last + 2) * n, np.uint16), np.arange(n)
        for i, draw in enumerate(np.ascontiguousarray(draws.T)):
            # The level where the chance reaches the draw, by at most two steps from a level that is not above it.
            first = np.clip(draw * (last / self.class_weight) - 1e-9, 0, last).astype(np.int64)
            first += rises[first] < draw
            first += rises[first] < draw
            out[first * n + column] |= np.uint16(1 << i)
        return np.bitwise_or.accumulate(out.reshape(-1, n)).reshape(-1)

    def store(self) -> None:
        c, unit = self.config, self.unit
        unit.bank.ta[:] = [[self.state >> p & c.top for p in row] for row in self.at]
        unit.bank.refresh(slice(None))
        unit.weight[:] = [self.weights >> self.w * i & self.mod for i in range(c.clauses)]
