"""Encoders, loaders, artifacts, distributed training and streams on Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.functions import bits as B
from ruleweave.functions import text as T
from ruleweave.operators import evaluate
from ruleweave.operators.encode import Encoder
from ruleweave.plans.models import CoalescedClassifier, ConvolutionalClassifier, VanillaAutoencoder, VanillaClassifier, VanillaRegressor
from ruleweave.sources import artifacts, loaders
from ruleweave.streaming import online


def samples(spark, n=300, f=6, seed=1):
    x = np.random.default_rng(seed).integers(0, 2, (n, f))
    rows = [(i, [int(v) for v in r], int(r[0] ^ r[1])) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label int")


def test_numeric_encoder(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(float("nan"),), (None,)], "v double")
    e = Encoder.fit_numeric(df.where("v is not null and not isnan(v)"), ["v"], 3)
    assert e.thresholds == [[2.0, 4.0, 6.0]] and e.bit_origin(1) == (0, 4.0)
    got = {str(r["v"]): r["bits"] for r in e.encode(df).collect()}
    assert got["5.0"] == [1, 1, 0] and got["nan"] == [0, 0, 0] and got["None"] == [0, 0, 0] and got["2.0"] == [0, 0, 0]


def test_categorical_encoder(spark):
    df = spark.createDataFrame([(["proc::cmd", "user::a"],), (["proc::ps", "user::b", "user::b"],)], "tokens array<string>")
    e = Encoder.fit_categorical(df)
    assert e.n_features() == 7 and e.vocab_token(6) == "<OOV>" and e.vocab_token(4) == "proc::<UNK>"
    new = spark.createDataFrame([(1, ["proc::new", "zzz", "user::a"])], "id int, tokens array<string>")
    assert e.encode(new).first()["bits"] == [0, 0, 1, 0, 1, 0, 1]
    assert sorted(r["bit"] for r in e.encode_relational(new, "id").collect()) == [2, 4, 6]
    more = spark.createDataFrame([(["proc::rundll32", "user::c", "host::web01"],)], "tokens array<string>")
    assert e.extend_categorical(more) == 4 and e.vocabulary["host::web01"] == 7 and e.oov == 6
    assert e.extend_categorical(more) == 0


def test_binary_encoder(spark):
    e = Encoder.for_binary(3)
    df = spark.createDataFrame([([1, 0, 5],)], "bits array<int>")
    assert e.encode(df).first()["bits"] == [1, 0, 1]
    e.grow_binary(5)
    assert e.encode(df).first()["bits"] == [1, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        e.grow_binary(2)
    with pytest.raises(TypeError):
        e.bit_origin(0)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 40])
def test_packing(spark, n):
    bits = [i % 3 == 0 for i in range(n)]
    df = spark.createDataFrame([([int(b) for b in bits],)], "bits array<tinyint>")
    words = df.select(B.pack(F.col("bits"), n).alias("w")).first()["w"]
    value = sum((w % (1 << 64)) << (64 * i) for i, w in enumerate(words))
    assert value == sum(1 << i if b else 1 << (n + i) for i, b in enumerate(bits)) and len(words) == B.words_for(2 * n)


def test_firing_of_empty_clauses(spark):
    df = spark.createDataFrame([([], [0, 3]), ([0], [0, 3]), ([0, 1], [0, 3])], "inc array<int>, lits array<int>")
    got = df.select(B.fires(F.col("inc"), F.col("lits")).alias("a"), B.fires(F.col("inc"), F.col("lits"), True).alias("b"), B.first_blocking(F.col("inc"), F.col("lits")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, True, None), (True, True, None), (False, False, 1)]


def test_text(spark):
    df = spark.createDataFrame([("HKLM\\Soft\\x.exe", "cmd.exe /c echo DEADBEEF;net user", "A=b=c\nZ=1\nbad")], "p string, c string, r string")
    r = df.select(T.basename(F.col("p")).alias("b"), T.hive(F.col("p")).alias("h"), T.is_hive(F.col("p")).alias("i"), T.command_tokens(F.col("c")).alias("t"), T.key_values(F.col("r"), ["A", "Z", "Q"]).alias("k")).first()
    assert (r.b, r.h, r.i, r.t) == ("x.exe", "HKLM", True, ["cmd.exe", "echo", "net", "user"]) and tuple(r.k) == ("b=c", "1", "")


def test_csv_and_sparse_readers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,y\n1.5,2,1\n\n3,4,2.5\n7\n")
    got = loaders.read_numeric_csv(spark, str(tmp_path / "n.csv")).orderBy("row_id").collect()
    assert [(r["features"], r["label"]) for r in got] == [([1.5, 2.0], 1), ([3.0, 4.0], 3)]
    (tmp_path / "bad.csv").write_text("1,2,1\nx,4,2\n")
    with pytest.raises(Exception, match="not a number"):
        loaders.read_numeric_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "b.csv").write_text("p,q,y\n0,7,1\n1,0,0\n")
    assert [(r["bits"], r["label"]) for r in loaders.read_binary_csv(spark, str(tmp_path / "b.csv")).orderBy("row_id").collect()] == [([0, 1], 1), ([1, 0], 0)]
    (tmp_path / "s.txt").write_text("1 0 2 2 99\n\n0\n")
    assert [(r["bits"], r["label"]) for r in loaders.read_sparse_binary(spark, str(tmp_path / "s.txt"), 4).orderBy("row_id").collect()] == [([1, 0, 1, 0], 1), ([0, 0, 0, 0], 0)]


def test_binary_matrices(spark, tmp_path):
    np.arange(6, dtype=np.uint8).tofile(tmp_path / "x.bin")
    np.array([3, 4], "<u4").tofile(tmp_path / "y.bin")
    np.array([0.5], "<f8").tofile(tmp_path / "z.bin")
    assert [r["bits"] for r in loaders.read_u8_matrix(spark, str(tmp_path / "x.bin"), 2, 3).orderBy("row_id").collect()] == [[0, 1, 1], [1, 1, 1]]
    assert [r["label"] for r in loaders.read_u32_vector(spark, str(tmp_path / "y.bin"), 2).orderBy("row_id").collect()] == [3, 4]
    assert loaders.read_f64_vector(spark, str(tmp_path / "z.bin"), 1).first()["target"] == 0.5
    with pytest.raises(Exception, match="bytes"):
        loaders.read_u8_matrix(spark, str(tmp_path / "x.bin"), 3, 3).collect()


def test_event_files(spark, tmp_path):
    (tmp_path / "a" / "__MACOSX").mkdir(parents=True)
    line = '{"Channel":"Microsoft-Windows-Sysmon/Operational","EventID":1,"EventTime":"2024-05-01 10:00:01.5","Image":"C:\\\\W\\\\Cmd.exe","Signed":true}'
    (tmp_path / "a" / "lateral_x.json").write_text(line + "\nnot json\n" + line.replace('"EventID":1', '"EventID":3') + "\n")
    (tmp_path / "a" / "__MACOSX" / "b.json").write_text(line + "\n")
    (tmp_path / "tactic_map.json").write_text(line + "\n")
    got = loaders.read_process_events(spark, str(tmp_path))
    r = got.collect()
    assert len(r) == 1 and r[0]["image"] == "Cmd.exe" and r[0]["company"] == "<unknown>" and not r[0]["signed"] and r[0]["parent"] == ""
    labels = spark.createDataFrame([("lat", 1), ("lateral", 2)], "stem string, label int")
    assert loaders.label_files(got, labels).first()["label"] == 2


def test_spark_training_equals_local(spark):
    x, df = samples(spark)
    y = x[:, 0] ^ x[:, 1]
    a, b = VanillaClassifier(2, 6, 6, 8, 3.0, seed=5).fit(df, epochs=2), VanillaClassifier(2, 6, 6, 8, 3.0, seed=5).fit_local(x, y, 2)
    assert all((u.bank.ta == v.bank.ta).all() and (u.weight == v.weight).all() for u, v in zip(a.units, b.units))
    assert a.accuracy(df) == (b.predict(x) == y).mean()


def test_joins_and_arrays_agree(spark):
    x, df = samples(spark)
    m = VanillaClassifier(2, 6, 6, 8, 3.0, seed=5).fit_local(x, x[:, 0] ^ x[:, 1], 2)
    voted = evaluate.votes(df, evaluate.fired(df, m.clause_lits(spark).drop("state")), m.weights(spark), 2)
    got = {r["row_id"]: r["prediction"] for r in evaluate.argmax(evaluate.scores(voted, 8)).collect()}
    assert [got[i] for i in range(len(x))] == m.predict(x).tolist()
    c = CoalescedClassifier(2, 6, 8, 8, 3.0, seed=5).fit_local(x, x[:, 0] ^ x[:, 1], 2)
    got = {r["row_id"]: r["prediction"] for r in evaluate.predict_coalesced(df, c.clause_lits(spark).drop("state"), c.weights(spark), 2).collect()}
    assert [got[i] for i in range(len(x))] == c.predict(x).tolist()


def test_replicas(spark):
    x, df = samples(spark, 600)
    m = VanillaClassifier(2, 6, 10, 10, 3.0, seed=5)
    m.fit(df, epochs=4, strategy="data_parallel", replicas=2)
    assert m.accuracy(df) > 0.8
    with pytest.raises(ValueError):
        VanillaRegressor(6, 10, 10, 3.0).fit(df, strategy="data_parallel")


def test_artifacts(spark, tmp_path):
    x, df = samples(spark, 80)
    y = x[:, 0] ^ x[:, 1]
    m = VanillaClassifier(2, 6, 6, 8, 3.0, seed=5).fit_local(x, y, 1)
    artifacts.save(spark, m, str(tmp_path / "m"))
    again = artifacts.load(spark, str(tmp_path / "m"), "vanilla")
    assert (again.fit_local(x, y, 1).units[0].bank.ta == m.fit_local(x, y, 1).units[0].bank.ta).all()  # training goes on alike
    with pytest.raises(artifacts.ArtifactError):
        artifacts.load(spark, str(tmp_path / "m"), "sparse")
    for bad in (b"", b"garbage", artifacts.to_bytes(m)[:-20]):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.from_bytes(bad)
    assert artifacts.from_bytes(artifacts.to_bytes(Encoder.for_binary(3)), "encoder").width == 3


def test_autoencoder_and_errors(spark):
    half = np.random.default_rng(0).integers(0, 2, (150, 3))
    rows = [(i, [int(v) for v in [*r, *r]]) for i, r in enumerate(half)]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>")
    m = VanillaAutoencoder(6, 10, 10, 3.0, seed=1).fit(df, label=None, epochs=3)
    assert m.reconstruction_accuracy(df) > 0.8


def test_streams(spark, tmp_path):
    x, df = samples(spark, 200)
    df.write.parquet(str(tmp_path / "in"))
    m = VanillaClassifier(2, 6, 10, 10, 3.0, seed=5)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    online.train_stream(stream, m, str(tmp_path / "c1"), epochs=3, save_to=str(tmp_path / "models")).awaitTermination()
    assert m.accuracy(df) > 0.7
    q = online.score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), m).select("row_id", "prediction", "margin").writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").count() == 200


def test_window_stream(spark, tmp_path):
    ev = spark.range(100).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").alias("who"))
    ev.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = online.windowed_features(s, "ts", "10 minutes", "5 minutes", ["0", "1"], F.col("kind"), F.col("who")).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("win").collect()
    assert got and all(len(r["bits"]) == 2 * 3 + 4 + 3 for r in got)


def test_growing_model(spark):
    e = Encoder.fit_categorical(spark.createDataFrame([(["a::x", "b::y"],)], "tokens array<string>"))
    m = VanillaClassifier(2, e.n_features(), 4, 5, 3.0, seed=1)
    batch = spark.createDataFrame([(i, ["a::x" if i % 2 else "a::z", "c::q"], i % 2) for i in range(40)], "row_id bigint, tokens array<string>, label int")
    assert online.grow_and_train(batch, e, m) == 3 and m.n_features() == e.n_features()


@pytest.mark.parametrize("held", [0, 5_000])
def test_expressions_and_joins_agree(spark, monkeypatch, held):
    monkeypatch.setattr(evaluate, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(i, [int(b) for b in rng.integers(0, 2, 6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>")
    m = VanillaClassifier(3, 6, 8, 5, 3.0, seed=2).fit_local(np.array([b for _, b in rows]), rng.integers(0, 3, 80).astype(float), epochs=3)
    x, lits = np.array([b for _, b in rows]), m.clause_lits(spark).drop("state")
    plain = m.weights(spark).select("output", "clause", F.abs("weight").alias("weight"))
    got = {r["row_id"]: r["prediction"] for r in evaluate.predict_vanilla(df, lits, plain, 3, 5).collect()}
    assert got == dict(enumerate(m.predict(x).tolist()))
    patches = B.patches_1d(F.col("bits"), 6, 3)
    c = ConvolutionalClassifier(2, 6, 4, 5, 3.0, 3, seed=4).fit_local(x, (x[:, 0] ^ x[:, 1]).astype(float), epochs=2)
    own = c.weights(spark).select("output", "clause", F.abs("weight").alias("weight"))
    found = {r["row_id"]: r["prediction"] for r in evaluate.predict_convolutional(df, c.clause_lits(spark).drop("state"), own, 2, 5, patches).collect()}
    assert found == dict(enumerate(c.predict(x).tolist()))
    total = {r["row_id"]: r["prediction"] for r in evaluate.predict_regression(df, lits.where("output = 0"), plain.where("output = 0"), 4).collect()}
    assert len(total) == 80 and all(0 <= v <= 4 for v in total.values())
