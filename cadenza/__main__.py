"""Command lines: `python -m cadenza train --config ...` and `python -m cadenza predict --model ... --wav ...`."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza.operators import labels
from cadenza.plans import features, predict, train
from cadenza.session import share_code
from cadenza.sources import audio, config, manifest


def parsed(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cadenza", description="Train a clip classifier, or classify clips.")
    commands = parser.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("train", help="learn from the clips of a manifest and write the best model")
    fit.add_argument("--train", required=True, help="CSV manifest (filepath, label) of clips to learn from")
    fit.add_argument("--valid", required=True, help="CSV manifest of clips to choose the best epoch by")
    fit.add_argument("--root", required=True, help="folder that the manifests' paths begin at")
    score = commands.add_parser("predict", help="print the class of each clip and all classes' probabilities")
    score.add_argument("--wav", required=True, help="a WAV file, folder or glob")
    for command in (fit, score):
        command.add_argument("--model", required=True, help="folder of the model")
        command.add_argument("--config", help="YAML settings; without it the defaults")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    """Runs on the session that spark-submit gives, or a local one."""
    given = parsed(args)
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    share_code(spark)
    cfg = config.read_config(given.config) if given.config else config.Config()
    if given.command == "train":

        def clips(path: str):
            rows = audio.read_clips(spark, manifest.read_manifest(spark, path), given.root, cfg.data.sr)
            return labels.encode(rows, list(cfg.data.labels)).withColumn("clip_id", F.col("filepath"))

        rows = clips(given.train)
        table = (lambda epoch: features.feature_table(rows, cfg, epoch)) if cfg.preprocess.crop == "random" else features.feature_table(rows, cfg).cache()
        model = train.fit(table, features.feature_table(clips(given.valid), cfg).cache(), cfg)
        for row in model.history:
            print("epoch {epoch}: loss {loss:.4f}, accuracy {macro_accuracy:.4f}, F1 {macro_f1:.4f}".format(**row))
        model.save(spark, given.model)
        return
    model = train.load(spark, given.model)
    clips = audio.read_wav(spark, given.wav, cfg.data.sr).withColumn("clip_id", F.col("filepath"))
    found = predict.predict(features.feature_table(clips, cfg), model.params, model.shape, model.labels)
    for row in found.orderBy("clip_id").select("clip_id", "pred").toLocalIterator():
        print(f"{os.path.basename(row.clip_id)}: {row.pred}")
    for row in predict.report_lines(found, model.labels).orderBy("clip_id", "k").toLocalIterator():
        print(row.line)


if __name__ == "__main__":
    main()
