"""Model checkpoints as Parquet tables: one row for each parameter, and one that describes the model."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "name STRING, shape ARRAY<INT>, data ARRAY<FLOAT>, meta STRING"


def save(spark: SparkSession, path: str, params: dict[str, np.ndarray], meta: dict) -> None:
    rows = [(k, list(v.shape), v.astype(np.float32).ravel().tolist(), None) for k, v in params.items()]
    rows.append((None, None, None, json.dumps(meta)))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, expected: dict[str, tuple[int, ...]] | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """(parameters, description); names and shapes must be the expected ones, if given."""
    table = spark.read.schema(SCHEMA).parquet(path)
    meta = json.loads(table.where(F.col("name").isNull()).first()["meta"])
    rows = table.where(F.col("name").isNotNull()).collect()  # as many as the model has parameters
    params = {r["name"]: np.array(r["data"], np.float32).reshape(r["shape"]) for r in rows}
    if expected is not None:
        have = {k: v.shape for k, v in params.items()}
        if have != {k: tuple(v) for k, v in expected.items()}:
            raise ValueError(f"parameters differ from the model's: {sorted(set(have.items()) ^ set(expected.items()))[:4]}")
    return params, meta
