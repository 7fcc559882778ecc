"""The eight model families: training as Spark jobs over units, prediction as a vectorised pass, state as tables.

Training, exact: each unit (class, output or member) depends on the order of
samples but on no other unit, so the packed samples are replicated to the units
and one task trains each, all epochs in one job. A unit holds the packed samples
(features / 8 bytes a row) in memory; where that is too much, or for models of
one shared bank, strategy="data_parallel" streams each partition through a
replica and merges replicas, epoch by epoch, in memory of one model. Small
classes are trained in lanes (ruleweave.operators.lanes), with the same result.

Prediction broadcasts included literals (their size is the model's, checked
against BROADCAST_BYTES) and evaluates Arrow batches; ruleweave.operators.evaluate
gives the same results as joins, for models beyond that size.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ruleweave.operators import kernels, lanes
from ruleweave.operators.kernels import Config, EncoderUnit, RegressionUnit, SharedUnit, VotingUnit, merge
from ruleweave.plans.ship import ship

BROADCAST_BYTES = 256 << 20


def packed(df: DataFrame, bits: str, label: str | None, key: str) -> DataFrame:
    """(key, y, x): samples with features packed eight to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.packbits(_matrix(b.column("x")) != 0, axis=1)
                rows = pa.Array.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), rows], ["key", "y", "x"])

    y = F.lit(0.0) if label is None else F.col(label).cast("double")
    return df.select(F.col(key).cast("bigint").alias("key"), y.alias("y"), F.col(bits).alias("x")).mapInArrow(run, "key bigint, y double, x binary")


def _matrix(rows: pa.Array) -> np.ndarray:
    """(row, feature) of arrays of one length."""
    sizes = np.unique(rows.value_lengths().to_numpy(zero_copy_only=False))
    if rows.null_count or len(sizes) > 1:
        raise ValueError("every sample needs features, all the same number")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of numbers, or of the rows of a matrix."""
    if values.ndim == 1:
        return pa.array(values, kind)
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), kind.value_type)).cast(kind)


def _bytes(rows: pa.Array) -> np.ndarray:
    """(row, byte) of binary rows of one length."""
    held = rows.cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(held), -1)


def _unpack(x: list[bytes], n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1), axis=1)[:, :n]


class RuleModel:
    """What the families share. Subclasses set `units`, `outputs`, `last_wins` and how a sample trains a unit."""

    family = "model"
    last_wins = False
    can_data_parallel = False
    can_grow = False

    def __init__(self, config: Config):
        self.config, self.units = config, []

    # Accessors.
    def n_features(self) -> int:
        return self.config.n_features

    def n_clauses(self) -> int:
        return self.config.clauses

    def threshold(self) -> int:
        return self.config.threshold

    def s(self) -> float:
        return self.config.s

    def words_per_sample(self) -> int:
        return -(-2 * self.config.n_features // 64)

    def n_outputs(self) -> int:
        return len(self.units)

    def clause_weight(self, output: int, clause: int) -> int:
        return int(self.units[output].weight[clause])

    def clause_rule(self, output: int, clause: int) -> list[tuple[int, bool]]:
        """(feature, negated) of the included literals, sorted."""
        bank = self._bank(output)
        width = bank.ta.shape[1] // 2
        return sorted((int(i) % width, bool(i >= width)) for i in np.nonzero(bank.included[clause])[0])

    def clause_is_positive(self, output: int, clause: int) -> bool:
        return clause % 2 == 0

    def fired_clauses(self, output: int, bits) -> list[int]:
        return np.nonzero(self.units[output].fired(np.asarray(bits)))[0].tolist()

    def _bank(self, output: int) -> kernels.Bank:
        return self.units[output].bank

    def _banks(self) -> list[kernels.Bank]:
        return [u.bank for u in self.units]

    def absorbed_include_fraction(self) -> float:
        return float(np.mean([(b.ta == self.config.top).mean() for b in self._banks()]))

    def absorbed_exclude_fraction(self) -> float:
        return float(np.mean([(b.ta == 0).mean() for b in self._banks()]))

    def set_rules(self, rules: list[tuple[int, int, int, bool]], weights: list[tuple[int, int, int]]) -> "RuleModel":
        """Take up given rules (output, clause, feature, negated) and weights (output, clause, weight) in place of learned ones.

        Included counters stand at `half`, all others just below. For families of one bank, the rules' output is left out of account.
        """
        for bank in self._banks():
            bank.ta[:] = self.config.half - 1
        for output, clause, feature, negated in rules:
            bank = self._bank(output)
            bank.ta[clause, feature + (bank.ta.shape[1] // 2 if negated else 0)] = self.config.half
        for bank in self._banks():
            bank.refresh(slice(None))
        for output, clause, weight in weights:
            unit = self.units[output if len(self.units) > 1 else 0]
            unit.weight[(output, clause) if unit.weight.ndim == 2 else clause] = weight
        return self

    def input_shape(self) -> tuple[int, int]:
        """(rows, columns) of a sample: its image, or one row of all features."""
        return self.config.shape or (1, self.config.n_features)

    # Training.
    def _train(self, unit, index: int, bits: np.ndarray, y: float, other: int) -> None:
        raise NotImplementedError

    def _others(self, generator: np.random.Generator, y: np.ndarray) -> np.ndarray:
        """For each sample, the output that it trains as a negative; -1 for none."""
        return np.full(len(y), -1)

    def _relevant(self, index: int, y: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.ones(len(y), bool)

    def _schedule(self, index: int, y: np.ndarray, epochs: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each epoch, the samples that train a unit, in order, and every sample's other output."""
        for epoch in range(first, first + epochs):
            schedule = np.random.default_rng((self.config.seed, 0x5EED, epoch))
            order, other = schedule.permutation(len(y)), self._others(schedule, y)
            yield order[self._relevant(index, y, other)[order]], other

    def _epochs(self, unit, index: int, x: np.ndarray, y: np.ndarray, epochs: int, first: int) -> None:
        for order, other in self._schedule(index, y, epochs, first):
            for i in order.tolist():
                self._train(unit, index, x[i], y[i], int(other[i]))

    def fit_one(self, bits, y=0) -> None:
        """Train on one sample, here."""
        x, y = np.asarray(bits)[None, :], np.array([float(y)])
        other = self._others(np.random.default_rng((self.config.seed, 0x0E, self._seen())), y)
        for index, unit in enumerate(self.units):
            if self._relevant(index, y, other)[0]:
                self._train(unit, index, x[0], y[0], int(other[0]))
        self.steps = self._seen() + 1

    def _seen(self) -> int:
        return getattr(self, "steps", 0)

    def fit_local(self, x: np.ndarray, y: np.ndarray | None = None, epochs: int = 1) -> "RuleModel":
        """Train on arrays, here; the same result as fit on the same rows in the order of their keys."""
        y = np.zeros(len(x)) if y is None else np.asarray(y, float)
        for index, unit in enumerate(self.units):
            self._epochs(unit, index, np.asarray(x), y, epochs, self._seen())
        self.steps = self._seen() + epochs
        return self

    def fit(self, df: DataFrame, label: str | None = "label", bits: str = "bits", key: str = "row_id", epochs: int = 1, strategy: str = "exact", replicas: int = 4) -> "RuleModel":
        """Train on samples; `exact` or `data_parallel` (see the module)."""
        ship(df.sparkSession)
        rows = packed(df, bits, label, key)
        if strategy == "data_parallel":
            if not self.can_data_parallel or self.config.type_iii is not None:
                raise ValueError("this model can't train on replicas")
            for _ in range(epochs):
                self._replica_epoch(rows, replicas)
            return self
        spark, n = df.sparkSession, self.config.n_features
        blob, first = spark.sparkContext.broadcast(pickle.dumps(self)), self._seen()

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, keys, ys, xs = None, [], [], []
            for b in batches:
                if b.num_rows:
                    index = b.column("unit")[0].as_py()
                    keys.append(b.column("key").to_numpy(zero_copy_only=False))
                    ys.append(b.column("y").to_numpy(zero_copy_only=False))
                    xs.append(_bytes(b.column("x")))
            if index is None:
                return
            model, order = pickle.loads(blob.value), np.argsort(np.concatenate(keys), kind="stable")
            unit, y, x = model.units[index], np.concatenate(ys)[order], np.concatenate(xs)[order]
            keys, ys, xs, order = [], [], [], None
            model._epochs(unit, index, np.unpackbits(x, axis=1)[:, :n], y, epochs, first)
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.int32()), pa.array([pickle.dumps(unit)], pa.binary())], ["unit", "state"])

        units = F.explode(F.sequence(F.lit(0), F.lit(len(self.units) - 1)))
        # A partition for each unit: by hash, several would share one and wait for each other.
        trained = rows.withColumn("unit", units).repartitionById(len(self.units), F.col("unit")).mapInArrow(train, "unit int, state binary").collect()  # one state a unit
        for r in trained:
            self.units[r["unit"]] = pickle.loads(r["state"])
        self.steps = first + epochs
        return self

    def _replica_epoch(self, rows: DataFrame, replicas: int) -> None:
        blob, n, step = rows.sparkSession.sparkContext.broadcast(pickle.dumps(self)), self.config.n_features, self._seen()

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, number = pickle.loads(blob.value), None
            for b in batches:
                if not len(b):
                    continue
                if number is None:
                    number = int(b["replica"].iloc[0])
                    for u in model.units:
                        u.generator = np.random.default_rng((model.config.seed, step, number, getattr(u, "unit", 0)))
                x, y = _unpack(b["x"].tolist(), n), b["y"].to_numpy()
                schedule = np.random.default_rng((model.config.seed, step, number, len(b)))
                order, other = schedule.permutation(len(y)), model._others(schedule, y)
                for index, unit in enumerate(model.units):
                    mine = model._relevant(index, y, other)
                    for i in order[mine[order]].tolist():
                        model._train(unit, index, x[i], y[i], int(other[i]))
            if number is not None:
                for index, unit in enumerate(model.units):
                    yield pd.DataFrame({"unit": [index], "replica": [number], "state": [pickle.dumps(unit)]})

        def join(group: pd.DataFrame) -> pd.DataFrame:
            states = [pickle.loads(s) for s in group.sort_values("replica")["state"]]
            return pd.DataFrame({"unit": [int(group["unit"].iloc[0])], "state": [pickle.dumps(merge(states))]})

        dealt = rows.withColumn("replica", F.pmod(F.xxhash64("key"), F.lit(replicas)).cast("int")).repartitionByRange(replicas, "replica").sortWithinPartitions("replica", "key")
        merged = dealt.mapInPandas(train, "unit int, replica int, state binary").groupBy("unit").applyInPandas(join, "unit int, state binary").collect()
        for r in merged:
            self.units[r["unit"]] = pickle.loads(r["state"])
        self.steps = step + 1

    # Prediction.
    def votes(self, x: np.ndarray) -> np.ndarray:
        """Unclamped votes (row, output) of rows of features."""
        lit = kernels.literals(np.asarray(x) != 0).astype(np.float32)
        out = np.zeros((len(x), len(self.units)), np.int64)
        for o, u in enumerate(self.units):
            fired = ((1 - lit) @ u.bank.included.T.astype(np.float32) == 0) & u.bank.included.any(axis=1)
            out[:, o] = fired @ (u.sign * u.weight)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.votes(x), -self.config.threshold, self.config.threshold)

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        return s.shape[1] - 1 - s[:, ::-1].argmax(axis=1) if self.last_wins else s.argmax(axis=1)

    def _over(self, df: DataFrame, bits: str, schema: str, make: Callable[["RuleModel", np.ndarray], dict]) -> DataFrame:
        state = pickle.dumps(self)
        if len(state) > BROADCAST_BYTES:
            raise ValueError("the model is too large to broadcast; score its tables with ruleweave.operators.evaluate")
        ship(df.sparkSession)
        blob = df.sparkSession.sparkContext.broadcast(state)
        added = StructType.fromDDL(schema)
        kinds = {f.name: f.type for f in to_arrow_schema(added)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = pickle.loads(blob.value)
            for b in batches:
                if b.num_rows:
                    columns = dict(zip(b.schema.names, b.columns))
                    made = make(model, _matrix(columns[bits]))
                    columns |= {name: _column(made[name], kind) for name, kind in kinds.items()}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        kept = [f for f in df.schema.fields if f.name not in kinds]
        return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, StructType(kept + added.fields))

    def transform(self, df: DataFrame, bits: str = "bits") -> DataFrame:
        """df with prediction int and scores array<bigint>."""
        return self._over(df, bits, "prediction int, scores array<bigint>", lambda m, x: {"prediction": m.predict(x), "scores": m.scores(x)})

    def accuracy(self, df: DataFrame, label: str = "label", bits: str = "bits") -> float:
        """Share of rows whose prediction is the label; NaN over none."""
        found = self.transform(df.select(F.col(label).alias("label"), F.col(bits).alias("bits"))).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        return float("nan") if found is None else found

    # Tables.
    def clause_lits(self, spark: SparkSession) -> DataFrame:
        """(output, clause, feature, negated, state) of the included literals."""
        rows = []
        for o, bank in enumerate(self._banks()):
            width = bank.ta.shape[1] // 2
            rows += [(self._output_name(o), int(c), int(i) % width, bool(i >= width), int(bank.ta[c, i])) for c, i in zip(*np.nonzero(bank.included))]
        return spark.createDataFrame(rows, "output int, clause int, feature int, negated boolean, state int")

    def _output_name(self, o: int) -> int:
        return o

    def weights(self, spark: SparkSession) -> DataFrame:
        """(output, clause, weight), signed."""
        return spark.createDataFrame([(o, c, int(w)) for o, u in enumerate(self.units) for c, w in enumerate(u.sign * u.weight)], "output int, clause int, weight int")

    def grow_features(self, n_features: int) -> None:
        if not self.can_grow:
            raise ValueError("this model can't grow")
        for bank in self._banks():
            bank.grow(n_features)
        self.config = Config(**{**self.config.__dict__, "n_features": n_features})
        for u in self.units:
            u.config = u.bank.config = self.config


class _Classes(RuleModel):
    """Classifiers with a unit per class: the label's unit and one other's learn from each sample."""

    def _others(self, generator: np.random.Generator, y: np.ndarray) -> np.ndarray:
        k = len(self.units)
        draw = generator.integers(0, k - 1, len(y))
        return draw + (draw >= y)

    def _relevant(self, index: int, y: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (y == index) | (other == index)

    def _train(self, unit, index, bits, y, other) -> None:
        unit.update(bits, int(y) == index)

    def _epochs(self, unit, index, x, y, epochs, first) -> None:
        if not lanes.fits(unit) or x.shape[1] != self.n_features() or not np.isfinite(y).all():
            return super()._epochs(unit, index, x, y, epochs, first)
        state, rows, own = lanes.Lanes(unit), lanes.numbers(x), np.trunc(y) == index
        for order, _ in self._schedule(index, y, epochs, first):
            state.train(rows[order], own[order])
        state.store()

    def n_classes(self) -> int:
        return len(self.units)

    def clauses_per_class(self) -> int:
        return self.config.clauses

    def class_weight(self, k: int) -> float:
        return self.config.class_weights[k] if self.config.class_weights else 1.0


class VanillaClassifier(_Classes):
    family, can_data_parallel, can_grow = "vanilla", True, True

    def __init__(self, n_classes: int, n_features: int, clauses_per_class: int, threshold: int, s: float, **options):
        if n_classes < 2 or clauses_per_class < 2:
            raise ValueError("two classes and two clauses are needed")
        super().__init__(Config(n_features, clauses_per_class, threshold, s, **options))
        if self.config.class_weights is not None and len(self.config.class_weights) != n_classes:
            raise ValueError("a weight per class is needed")
        self.units = [VotingUnit(self.config, k) for k in range(n_classes)]


class SparseClassifier(VanillaClassifier):
    """Literals that are excluded for good are removed."""

    family, can_data_parallel = "sparse", False

    def __init__(self, n_classes: int, n_features: int, clauses_per_class: int, threshold: int, s: float, **options):
        if options.get("type_iii") is not None:
            raise ValueError("sparse clauses have no Type III feedback")
        super().__init__(n_classes, n_features, clauses_per_class, threshold, s, **options)
        self.units = [VotingUnit(self.config, k, sparse=True) for k in range(n_classes)]

    def absorbed_exclude_fraction(self) -> float:
        return float(np.mean([b.gone.mean() for b in self._banks()]))


class ConvolutionalClassifier(_Classes):
    """Clauses see patches, of one dimension (kernel an int) or two (shape and kernel pairs); the last class wins ties."""

    family, last_wins = "convolutional", True

    def __init__(self, n_classes: int, n_features: int, clauses_per_class: int, threshold: int, s: float, kernel: int | tuple[int, int], stride: int = 1, shape: tuple[int, int] = (), **options):
        if clauses_per_class % 2:
            raise ValueError("clauses per class must be even")
        if options.get("class_weights") is not None:
            raise ValueError("convolutional models have no class weights")
        sides = (kernel,) if isinstance(kernel, int) else tuple(kernel)
        limits = (n_features,) if len(sides) == 1 else shape
        if len(limits) != len(sides) or any(not 0 < k <= m for k, m in zip(sides, limits)) or stride < 1 or (len(sides) == 2 and shape[0] * shape[1] != n_features):
            raise ValueError("the kernel must fit the input")
        super().__init__(Config(n_features, clauses_per_class, threshold, s, kernel=sides, stride=stride, shape=tuple(shape), **options))
        self.units = [VotingUnit(self.config, k) for k in range(n_classes)]

    def patch_rows(self) -> int:
        return (self.config.shape[0] - self.config.kernel[0]) // self.config.stride + 1 if self.config.shape else 1

    def patch_cols(self) -> int:
        size, k = (self.config.shape[1], self.config.kernel[1]) if self.config.shape else (self.config.n_features, self.config.kernel[0])
        return (size - k) // self.config.stride + 1

    def n_patches(self) -> int:
        return self.patch_rows() * self.patch_cols()

    def kernel_size(self) -> int:
        return self.config.width

    def stride(self) -> int:
        return self.config.stride

    def votes(self, x: np.ndarray) -> np.ndarray:
        lit = np.stack([kernels.literals(kernels.patches(np.asarray(r) != 0, self.config)) for r in x]).astype(np.float32) if len(x) else np.zeros((0, 1, 2 * self.config.width), np.float32)
        out = np.zeros((len(x), len(self.units)), np.int64)
        for o, u in enumerate(self.units):
            fired = (((1 - lit) @ u.bank.included.T.astype(np.float32) == 0) & u.bank.included.any(axis=1)).any(axis=1)
            out[:, o] = fired @ (u.sign * u.weight)
        return out


class CompositeClassifier(RuleModel):
    """Members vote with their clamped scores; the last class wins ties."""

    family, last_wins = "composite", True

    def __init__(self, members: list[VanillaClassifier] | None = None):
        self.members: list[VanillaClassifier] = []
        for m in members or []:
            self.add(m)

    def add(self, member: VanillaClassifier) -> None:
        if self.members and (member.n_classes(), member.n_features()) != (self.members[0].n_classes(), self.members[0].n_features()):
            raise ValueError("members must agree on classes and features")
        self.members.append(member)
        self.config = self.members[0].config

    def __len__(self) -> int:
        return len(self.members)

    def is_empty(self) -> bool:
        return not self.members

    def classifiers(self) -> list[VanillaClassifier]:
        return self.members

    def n_classes(self) -> int:
        return self.members[0].n_classes()

    @property
    def units(self) -> list:
        """The members' units, one member after another."""
        return [u for m in self.members for u in m.units]

    def n_outputs(self) -> int:
        return self.n_classes()

    def fit_one(self, bits, y=0) -> None:
        for m in self.members:
            m.fit_one(bits, y)

    def fit(self, df: DataFrame, **options) -> "CompositeClassifier":
        for m in self.members:
            m.fit(df, **options)
        return self

    def fit_local(self, x, y=None, epochs: int = 1) -> "CompositeClassifier":
        for m in self.members:
            m.fit_local(x, y, epochs)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(m.scores(x) for m in self.members)


class VanillaRegressor(RuleModel):
    family = "regressor"

    def __init__(self, n_features: int, clauses: int, threshold: int, s: float, **options):
        if options.get("class_weights") is not None:
            raise ValueError("a regressor has no class weights")
        super().__init__(Config(n_features, clauses, threshold, s, **options))
        self.units = [RegressionUnit(self.config)]

    def _train(self, unit, index, bits, y, other) -> None:
        unit.update(bits, y)

    def votes(self, x: np.ndarray) -> np.ndarray:
        u, lit = self.units[0], kernels.literals(np.asarray(x) != 0).astype(np.float32)
        fired = ((1 - lit) @ u.bank.included.T.astype(np.float32) == 0) & u.bank.included.any(axis=1)
        return (fired @ u.weight.astype(np.int64))[:, None]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.votes(x)[:, 0], 0, self.config.threshold).astype(float)

    def fired_clauses(self, output: int, bits) -> list[int]:
        return np.nonzero(self.units[0].bank.fires(kernels.literals(np.asarray(bits)), training=False))[0].tolist()

    def transform(self, df: DataFrame, bits: str = "bits") -> DataFrame:
        return self._over(df, bits, "prediction double", lambda m, x: {"prediction": m.predict(x)})

    def _errors(self, df: DataFrame, target: str, bits: str) -> tuple[float, float]:
        e = F.col("prediction") - F.col("target")
        r = self.transform(df.select(F.col(target).cast("double").alias("target"), F.col(bits).alias("bits"))).agg(F.avg(F.abs(e)), F.sqrt(F.avg(e * e))).first()
        return float("nan") if r[0] is None else r[0], float("nan") if r[1] is None else r[1]

    def mae(self, df: DataFrame, target: str = "target", bits: str = "bits") -> float:
        return self._errors(df, target, bits)[0]

    def rmse(self, df: DataFrame, target: str = "target", bits: str = "bits") -> float:
        return self._errors(df, target, bits)[1]

    def weights(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(0, c, int(w)) for c, w in enumerate(self.units[0].weight)], "output int, clause int, weight int")


class _Shared(RuleModel):
    """Models of one bank with a signed weight per output and clause."""

    outputs = 0

    def n_outputs(self) -> int:
        return self.outputs

    def _output_name(self, o: int) -> int:
        return -1

    def _bank(self, output: int) -> kernels.Bank:
        return self.units[0].bank

    def clause_weight(self, output: int, clause: int) -> int:
        return int(self.units[0].weight[output, clause])

    def clause_is_positive(self, output: int, clause: int) -> bool:
        return self.units[0].weight[output, clause] >= 0

    def fired_clauses(self, output: int, bits) -> list[int]:
        return np.nonzero(self.units[0].bank.fires(kernels.literals(np.asarray(bits)), training=False))[0].tolist()

    def votes(self, x: np.ndarray) -> np.ndarray:
        u, lit = self.units[0], kernels.literals(np.asarray(x) != 0).astype(np.float32)
        fired = ((1 - lit) @ u.bank.included.T.astype(np.float32) == 0) & u.bank.included.any(axis=1)
        return fired.astype(np.int64) @ u.weight.T.astype(np.int64)

    def weights(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(o, c, int(w)) for o, row in enumerate(self.units[0].weight) for c, w in enumerate(row)], "output int, clause int, weight int")


class CoalescedClassifier(_Shared):
    """Predictions take unclamped votes; the first class wins ties."""

    family, can_data_parallel, can_grow = "coalesced", True, True

    def __init__(self, n_classes: int, n_features: int, clauses: int, threshold: int, s: float, **options):
        if n_classes < 2 or options.get("class_weights") is not None:
            raise ValueError("two classes are needed, and no class weights")
        super().__init__(Config(n_features, clauses, threshold, s, **options))
        self.outputs = n_classes
        self.units = [SharedUnit(self.config, n_classes)]

    def n_classes(self) -> int:
        return self.outputs

    def _train(self, unit, index, bits, y, other) -> None:
        unit.update(bits, int(y))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.votes(x).argmax(axis=1)


class _Reconstructs:
    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return (self.votes(x) > 0).astype(np.int8)

    def reconstruct_scores(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x)

    def transform(self, df: DataFrame, bits: str = "bits") -> DataFrame:
        """df with reconstruction array<int> and error double (share of bits that are wrong)."""
        return self._over(df, bits, "reconstruction array<int>, error double", lambda m, x: {"reconstruction": m.reconstruct(x), "error": (m.reconstruct(x) != (x != 0)).mean(axis=1)})

    def reconstruction_accuracy(self, df: DataFrame, bits: str = "bits") -> float:
        found = self.transform(df.select(F.col(bits).alias("bits"))).agg(1 - F.avg("error")).first()[0]
        return float("nan") if found is None else found


class VanillaAutoencoder(_Reconstructs, RuleModel):
    """A bank per output; an output's own literals are masked while it learns."""

    family = "autoencoder"

    def __init__(self, n_features: int, clauses_per_output: int, threshold: int, s: float, **options):
        if clauses_per_output < 2:
            raise ValueError("two clauses are needed")
        super().__init__(Config(n_features, clauses_per_output, threshold, s, **options))
        self.units = [EncoderUnit(self.config, k) for k in range(n_features)]

    def clauses_per_output(self) -> int:
        return self.config.clauses

    def _train(self, unit, index, bits, y, other) -> None:
        unit.update_output(bits)


class CoalescedAutoencoder(_Reconstructs, _Shared):
    family = "coalesced_autoencoder"

    def __init__(self, n_features: int, clauses: int, threshold: int, s: float, **options):
        super().__init__(Config(n_features, clauses, threshold, s, **options))
        self.outputs = n_features
        self.units = [SharedUnit(self.config, n_features)]

    def _train(self, unit, index, bits, y, other) -> None:
        unit.update_outputs(bits)


FAMILIES = {c.family: c for c in (VanillaClassifier, SparseClassifier, ConvolutionalClassifier, CompositeClassifier, VanillaRegressor, VanillaAutoencoder, CoalescedClassifier, CoalescedAutoencoder)}


def clone(model: RuleModel) -> RuleModel:
    return copy.deepcopy(model)
