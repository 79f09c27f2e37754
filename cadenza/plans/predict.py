"""Class probabilities of feature sequences by a stored model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.arrays import argmax_first, label_name, score_line
from cadenza.operators import sequence_model as sm

#: Sequences that are scored together.
BATCH = 32


def predict(features: DataFrame, params: sm.Params, shape: sm.Shape, labels: list[str]) -> DataFrame:
    """features with probs, pred_id and pred in place of x; sequences may differ in length."""
    number = params["out.w"].dtype
    # a model is a few MB, whatever the data
    model = features.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list = [None] * len(b)
            x = [np.stack([np.asarray(r, number) for r in v]) for v in b]
            by_length = sorted(range(len(x)), key=lambda i: len(x[i]))
            for i in range(0, len(x), BATCH):
                some = by_length[i : i + BATCH]
                for n in {len(x[j]) for j in some}:
                    own = [j for j in some if len(x[j]) == n]
                    for j, p in zip(own, sm.probabilities(sm.forward(model.value, shape, np.stack([x[j] for j in own]))[0]), strict=True):
                        out[j] = p.astype(float)
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = features.withColumn("probs", F.pandas_udf(run, "array<double>")("x")).drop("x")
    scored = scored.withColumn("pred_id", argmax_first(F.col("probs")))
    return scored.withColumn("pred", label_name(F.col("pred_id"), labels))


def report_lines(predictions: DataFrame, labels: list[str], key: str = "clip_id") -> DataFrame:
    """(key, k, line): each class and its probability as text."""
    rows = predictions.select(key, F.posexplode("probs").alias("k", "p"))
    return rows.select(key, "k", score_line(label_name(F.col("k"), labels), F.col("p")).alias("line"))
