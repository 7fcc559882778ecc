"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from ruleweave.plans import event_queries, model_queries, models, queries

QUERIES = queries.QUERIES | event_queries.QUERIES | model_queries.QUERIES
ORACLE = queries.ORACLE | event_queries.ORACLE | model_queries.ORACLE

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry_without_operators(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() > 0


def test_training_takes_all_rows(spark):
    """The registered model is the one that local training on every order gives."""
    rows = queries._samples(spark, FOLDER).orderBy("row_id").collect()
    x = np.array([r["bits"] for r in rows])
    model = models.VanillaClassifier(2, 9, 10, 10, 3.0, seed=7).fit_local(x, np.array([r["label"] for r in rows]), epochs=2)
    got = {r["row_id"]: r["prediction"] for r in QUERIES["train_and_predict"](spark, FOLDER).collect()}
    assert got == dict(zip([r["row_id"] for r in rows], model.predict(x).tolist()))


def test_all_events_are_encoded(spark, db):
    """Each event has a bit of its type and one of its user."""
    n = sum(r["n"] for r in QUERIES["categorical_encode"](spark, FOLDER).collect())
    assert n == 2 * db.execute("select count(*) from events").fetchone()[0]
