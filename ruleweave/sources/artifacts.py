"""Models and encoders at rest: one Parquet folder with a header row and the state, checked on reading."""

from __future__ import annotations

import io
import pickle

from pyspark.sql import SparkSession

from ruleweave.operators.encode import Encoder

#: The kinds of artifact by number.
KINDS = {"vanilla": 1, "coalesced": 2, "autoencoder": 3, "encoder": 4, "coalesced_autoencoder": 5, "regressor": 6, "convolutional": 7, "composite": 8, "sparse": 9}
FORMAT, VERSION = "ruleweave", 1


class ArtifactError(ValueError):
    """The artifact isn't one, or is of another version or kind."""


class _Known(pickle.Unpickler):
    """Reads states of this package and numpy alone."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] in ("ruleweave", "numpy") or (module, name) in {("builtins", "getattr"), ("copyreg", "_reconstructor"), ("builtins", "object"), ("builtins", "complex")}:
            return super().find_class(module, name)
        raise ArtifactError(f"an artifact can't hold {module}.{name}")


def kind_of(obj: object) -> str:
    return "encoder" if isinstance(obj, Encoder) else obj.family


def to_bytes(obj: object) -> bytes:
    """All learned state, generators included, so that training goes on as if it had not stopped."""
    return pickle.dumps({"format": FORMAT, "version": VERSION, "kind": kind_of(obj), "state": obj})


def from_bytes(data: bytes, kind: str | None = None) -> object:
    try:
        found = _Known(io.BytesIO(data)).load()
    except ArtifactError:
        raise
    except Exception as e:
        raise ArtifactError("not an artifact") from e
    return _checked(found, kind)


def _checked(found: object, kind: str | None) -> object:
    if not isinstance(found, dict) or found.get("format") != FORMAT:
        raise ArtifactError("not an artifact")
    if found["version"] != VERSION:
        raise ArtifactError(f"version {found['version']} isn't {VERSION}")
    if kind is not None and found["kind"] != kind:
        raise ArtifactError(f"a {found['kind']}, not a {kind}")
    return found["state"]


def save(spark: SparkSession, obj: object, path: str) -> None:
    """Write an artifact to a folder of any file system that Spark knows; what was there is replaced."""
    kind = kind_of(obj)
    spark.createDataFrame([(FORMAT, VERSION, KINDS[kind], kind, to_bytes(obj))], "format string, version int, tag int, kind string, payload binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, kind: str | None = None) -> object:
    row = spark.read.parquet(path).first()
    if row is None or "format" not in row or row["format"] != FORMAT:
        raise ArtifactError("not an artifact")
    if row["version"] != VERSION:
        raise ArtifactError(f"version {row['version']} isn't {VERSION}")
    if kind is not None and row["kind"] != kind:
        raise ArtifactError(f"a {row['kind']}, not a {kind}")
    return from_bytes(bytes(row["payload"]), kind)
