"""Truth tables, invariants and learning floors of the training kernels."""

import numpy as np
import pytest

from ruleweave.functions.rng import SplitMix64, binary_digits
from ruleweave.operators.kernels import Bank, Config, VotingUnit, literals, merge, patches
from ruleweave.plans.models import (
    CoalescedAutoencoder,
    CoalescedClassifier,
    CompositeClassifier,
    ConvolutionalClassifier,
    SparseClassifier,
    VanillaAutoencoder,
    VanillaClassifier,
    VanillaRegressor,
)


def xor(n, f, noise, seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 2, (n, f))
    y = x[:, 0] ^ x[:, 1]
    return x, np.where(r.random(n) < noise, 1 - y, y)


def bank(states, bits=8, **options):
    b = Bank(Config(len(states) // 2, 1, 10, 3.0, state_bits=bits, **options), np.random.default_rng(0))
    b.ta[0] = states
    b.refresh(slice(None))
    return b


def test_generator_vector():
    r = SplitMix64(42)
    assert [r.next() for _ in range(3)] == [0x28EFE333B266F103, 0x47526757130F9F52, 0x581CE1FF0E4AE394]
    assert binary_digits(0.625, 4) == [1, 0, 1, 0]


def test_literals_of_bits():
    assert np.nonzero(literals(np.array([1, 0, 1, 0])))[0].tolist() == [0, 2, 5, 7]


def test_weakening_of_absent_literals():
    b = bank([5, 1, 0, 15], 4)
    every = np.ones(4, bool)
    b.type_i(np.array([0]), np.array([False]), np.zeros(4, bool), every, every, every)
    assert b.ta[0].tolist() == [4, 0, 0, 15]


def test_rejection_lifts_absent_excluded():
    b = bank([3, 3, 8, 0, 7, 0], 4)
    b.type_ii(np.array([0]), np.array([False, True, False, False, False, True]), np.ones(6, bool))
    assert b.ta[0].tolist() == [4, 3, 8, 0, 8, 0]


def test_inclusion_boundary_and_firing():
    b = bank([127, 128])
    assert b.included[0].tolist() == [False, True]
    assert not b.fires(np.array([True, False]))[0] and b.fires(np.array([False, True]))[0]
    empty = bank([0, 0])
    assert empty.fires(np.array([True, False]))[0] and not empty.fires(np.array([True, False]), training=False)[0]


def test_indicator_decrement():
    b = bank([5, 5], 3, type_iii=2.0)
    b.ind[0] = [6, 2]
    b.type_iii(np.array([0]), np.array([True]), False, np.zeros(2, bool), np.ones(2, bool), 1.0, np.random.default_rng(0))
    assert b.ta[0].tolist() == [5, 4]


def test_absorbing_states_hold():
    b = bank([255, 255])
    for _ in range(300):
        b.type_i(np.array([0]), np.array([False]), np.zeros(2, bool), np.ones(2, bool), np.ones(2, bool), np.ones(2, bool))
    assert b.ta[0].tolist() == [255, 255]
    b = bank([0, 0])
    for _ in range(300):
        b.type_ii(np.array([0]), np.zeros(2, bool), np.ones(2, bool))
    assert b.ta[0].tolist() == [0, 0]


def test_growth_keeps_what_was_learned():
    m = VanillaClassifier(2, 12, 8, 15, 3.9, seed=42).fit_local(*xor(800, 12, 0.1, 1), 4)
    x, _ = xor(200, 12, 0, 3)
    before = m.scores(x)
    m.grow_features(20)
    assert (m.scores(np.concatenate([x, np.zeros((200, 8), int)], axis=1)) == before).all()
    with pytest.raises(ValueError):
        m.grow_features(5)


def test_weights_stay_in_bounds():
    m = VanillaClassifier(2, 6, 6, 5, 3.0, seed=1, max_included=3).fit_local(*xor(400, 6, 0.2, 1), 3)
    for u in m.units:
        assert u.weight.min() >= 1 and u.weight.max() <= 5


@pytest.mark.parametrize(
    "model, passes, floor",
    [
        (VanillaClassifier(2, 12, 8, 15, 3.9, seed=42), 6, 0.9),
        (SparseClassifier(2, 12, 20, 15, 3.9, seed=1), 6, 0.7),
        (CoalescedClassifier(2, 12, 20, 15, 3.9, seed=1), 6, 0.75),
        (VanillaClassifier(2, 12, 20, 15, 3.9, seed=3, type_iii=50.0), 4, 0.7),
    ],
)
def test_classifiers_learn(model, passes, floor):
    model.fit_local(*xor(1500, 12, 0.1, 1), passes)
    x, y = xor(600, 12, 0, 2)
    assert (model.predict(x) == y).mean() > floor


def test_other_families_learn():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (800, 4))
    conv = ConvolutionalClassifier(2, 4, 20, 15, 3.9, kernel=2, seed=2).fit_local(x, x[:, 0] ^ x[:, 1], 4)
    assert (conv.predict(x) == x[:, 0] ^ x[:, 1]).mean() > 0.6 and conv.n_patches() == 3
    x = r.integers(0, 2, (800, 10))
    reg = VanillaRegressor(10, 60, 100, 2.5, seed=2).fit_local(x, 10.0 * x.sum(axis=1), 4)
    assert np.abs(reg.predict(x) - 10.0 * x.sum(axis=1)).mean() < 25
    half = r.integers(0, 2, (400, 4))
    x = np.concatenate([half, half], axis=1)
    for m in (VanillaAutoencoder(8, 12, 20, 3.9, seed=1), CoalescedAutoencoder(8, 40, 40, 3.9, seed=1)):
        assert (m.fit_local(x, None, 3).reconstruct(x) == x).mean() > 0.8


def test_composite_takes_the_last_of_equals():
    m = CompositeClassifier([VanillaClassifier(2, 4, 2, 5, 3.0, seed=1)])
    for u in m.members[0].units:
        u.bank.ta[:] = 0
        u.bank.refresh(slice(None))
    assert m.predict(np.zeros((1, 4))).tolist() == [1] and m.members[0].predict(np.zeros((1, 4))).tolist() == [0]
    with pytest.raises(ValueError):
        m.add(VanillaClassifier(3, 4, 2, 5, 3.0))


def test_merge_rounds():
    units = [VotingUnit(Config(2, 2, 9, 3.0), 0) for _ in range(2)]
    units[0].bank.ta[:], units[1].bank.ta[:] = 3, 4
    units[0].weight[:], units[1].weight[:] = 1, 4
    m = merge(units)
    assert (m.bank.ta == 4).all() and (m.weight == 3).all()


def test_two_dimensional_patches():
    c = Config(8, 2, 5, 3.0, kernel=(2, 2), shape=(2, 4))
    assert patches(np.arange(8), c).tolist() == [[0, 1, 4, 5], [1, 2, 5, 6], [2, 3, 6, 7]]


@pytest.mark.parametrize("bad", [dict(s=1.0), dict(threshold=0), dict(state_bits=9), dict(clause_drop=1.0), dict(type_iii=1.0), dict(class_weights=(1.0, -1.0))])
def test_bad_parameters(bad):
    given = dict(threshold=5, s=3.0) | bad
    with pytest.raises(ValueError):
        VanillaClassifier(2, 4, 4, given.pop("threshold"), given.pop("s"), **given)
