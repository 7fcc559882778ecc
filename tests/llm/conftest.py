import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hard_table import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    # Columns whose names operators use themselves.
    for name in ("row", "id", "w", "key", "shard", "slot", "score", "lang_pred", "fp", "bucket", "n_tokens", "spans", "size"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
