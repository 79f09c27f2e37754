"""Training by synchronous rounds: an epoch is one Spark job of `workers` tasks.

By default each task runs mini-batches of its own clips from the common parameters and returns its parameters
and moments; their means, weighted by batches, begin the next epoch. With `together` = step the tasks share each
mini-batch: they are a barrier stage, each finds the gradient of its part of a batch, a ring of sockets sums
these, and all take the same step. That gives one worker's steps for any number of them, and one task's model
comes to the driver. A lost task fails the stage, and the epoch runs again from the state before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import sequence_model as sm
from cadenza.operators.batching import batches
from cadenza.operators.metrics import confusion, macro_scores
from cadenza.plans.predict import predict
from cadenza.plans.ring import Ring
from cadenza.sources import checkpoint
from cadenza.sources.config import Config


@dataclass
class Fitted:
    params: sm.Params
    shape: sm.Shape
    labels: list[str]
    #: One row an epoch: epoch, loss (moving average), macro_accuracy, macro_f1.
    history: list[dict]

    def save(self, spark, path: str) -> None:
        checkpoint.save(spark, path, self.params, {"labels": self.labels, "shape": self.shape.as_dict()})


def load(spark, path: str) -> Fitted:
    _, meta = checkpoint.load(spark, path)
    shape = sm.Shape(**meta["shape"])
    params, _ = checkpoint.load(spark, path, shape.sizes())
    return Fitted(params, shape, meta["labels"], [])


def epoch_rounds(rows: DataFrame, state: dict, shape: sm.Shape, cfg: Config, epoch: int) -> list[dict]:
    """What each worker returns: batches, losses, parameters and moments."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, losses, by = shared.value, [], {}
        params = now["params"]
        adam = sm.Adam(cfg.train.lr, cfg.train.weight_decay, dict(now["first"]), dict(now["second"]), now["step"])
        for part in parts:
            for r in part.to_pylist():
                own = by.setdefault(r["batch"], [])
                own.append((r["label_id"], np.array(r["x"], np.float32)))
                if len(own) < r["full"]:
                    continue
                x, y = np.stack([v for _, v in own]), np.array([k for k, _ in own])
                rng = np.random.default_rng([cfg.train.seed, epoch, r["batch"]])
                loss, g = sm.loss_and_gradients(params, shape, x, y, cfg.model.dropout, rng)
                params = adam.update(params, sm.clipped(g, cfg.train.grad_clip))
                losses.append(loss)
                del by[r["batch"]]
        if losses:
            out = {"n": len(losses), "losses": losses, "params": params, "first": adam.first, "second": adam.second, "step": adam.step}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["state"])

    return [pickle.loads(r["state"]) for r in rows.mapInArrow(run, "state binary").collect()]


def steps_together(rows: DataFrame, state: dict, shape: sm.Shape, cfg: Config, epoch: int, n: int) -> tuple[dict, list[float]]:
    """The state after an epoch of n mini-batches whose gradients are summed over the tasks, and the batches' losses.

    rows: batch, slot, label_id, x; a task has the slots of its number modulo the tasks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)
    sizes = shape.sizes()
    names = list(sizes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, losses = shared.value, []
        params = now["params"]
        adam = sm.Adam(cfg.train.lr, cfg.train.weight_decay, dict(now["first"]), dict(now["second"]), now["step"])
        source = (r for part in parts for r in part.to_pylist())
        held = next(source, None)
        with Ring() as ring:
            for batch in range(n):
                own = []
                while held is not None and held["batch"] == batch:
                    own.append(held)
                    held = next(source, None)
                # rows, loss, and gradient, each weighted by the rows
                found = np.zeros(2 + sum(int(np.prod(s)) for s in sizes.values()))
                if own:
                    x, y = np.stack([np.array(r["x"], np.float32) for r in own]), np.array([r["label_id"] for r in own])
                    rng = np.random.default_rng([cfg.train.seed, epoch, batch, own[0]["slot"]])
                    loss, g = sm.loss_and_gradients(params, shape, x, y, cfg.model.dropout, rng)
                    found = len(own) * np.concatenate([[1, loss], *(np.ravel(g[k]) for k in names)])
                found = ring.sum(found)
                losses.append(float(found[1] / found[0]))
                flat, at, g = found[2:] / found[0], 0, {}
                for k in names:
                    size = int(np.prod(sizes[k]))
                    g[k], at = flat[at : at + size].reshape(sizes[k]), at + size
                params = adam.update(params, sm.clipped(g, cfg.train.grad_clip))
            first = ring.rank == 0
        if first:
            out = {"params": params, "first": adam.first, "second": adam.second, "step": adam.step}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((out, losses))], pa.binary())], ["state"])

    rows = rows.select("batch", "slot", "label_id", "x").repartitionById(cfg.train.workers, F.col("slot") % cfg.train.workers)
    dealt = rows.sortWithinPartitions("batch", "slot")
    (done,) = dealt.mapInArrow(run, "state binary", barrier=True).collect()
    after, losses = pickle.loads(done["state"])
    shared.unpersist()
    return after, losses


def averaged(rounds: list[dict]) -> dict:
    total = sum(r["n"] for r in rounds)
    mean = lambda part: {k: (sum(r[part][k] * (r["n"] / total) for r in rounds)).astype(np.float32) for k in rounds[0][part]}
    return {p: mean(p) for p in ("params", "first", "second")} | {"step": max(r["step"] for r in rounds)}


def evaluate(features: DataFrame, params: sm.Params, shape: sm.Shape, labels: list[str]) -> dict:
    """macro_accuracy and macro_f1 over labelled features (0 without any)."""
    scored = predict(features, params, shape, labels)
    row = macro_scores(confusion(scored, "label_id", "pred_id")).first()
    return {k: row[k] or 0.0 for k in ("macro_accuracy", "macro_f1")}


def fit(train: DataFrame | Callable[[int], DataFrame], valid: DataFrame, cfg: Config) -> Fitted:
    """The model of the first epoch that reaches the best accuracy on valid.

    train and valid: (clip_id, label_id, x), with sequences of one length. train may be a function of
    the epoch instead, for random crops that differ from epoch to epoch. A last batch that isn't full
    is dropped.
    """
    of_epoch = train if callable(train) else lambda epoch: train
    train = of_epoch(0)
    n = train.count() // cfg.train.batch_size
    if not n:
        raise ValueError(f"training needs {cfg.train.batch_size} clips at least")
    labels = list(cfg.data.labels)
    width = len(train.select(F.element_at("x", 1).alias("r")).first()["r"])
    shape = sm.Shape(width, cfg.model.hidden_size, cfg.model.num_layers, len(labels))
    state = {"params": shape.new(cfg.train.seed), "first": {}, "second": {}, "step": 0}
    best, history, ema = (0.0, state["params"]), [], 0.0
    for epoch in range(cfg.train.epochs):
        dealt = batches(of_epoch(epoch).select("clip_id", "label_id", "x"), "clip_id", cfg.train.batch_size, cfg.train.seed, epoch, drop_last=True)
        if cfg.train.together == "step":
            state, losses = steps_together(dealt, state, shape, cfg, epoch, n)
        else:
            dealt = dealt.withColumn("full", F.lit(cfg.train.batch_size)).repartition(cfg.train.workers, "batch")
            rounds = epoch_rounds(dealt, state, shape, cfg, epoch)
            state, losses = averaged(rounds), [x for r in rounds for x in r["losses"]]
        ema = 0.0
        for loss in losses:
            ema = 0.9 * ema + 0.1 * loss
        scores = evaluate(valid, state["params"], shape, labels)
        history.append({"epoch": epoch, "loss": ema} | scores)
        if scores["macro_accuracy"] > best[0]:
            best = (scores["macro_accuracy"], state["params"])
    return Fitted(best[1], shape, labels, history)
