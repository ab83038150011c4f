"""The stages end to end: canonical rows, split, candidates, champion, one test."""

from __future__ import annotations

import subprocess
import sys
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.models import regress
from tidewright.operators import canonical, contracts, features, metrics, split
from tidewright.session import stage
from tidewright.sources import publish, scan

Z = tuple(f"z_{c}" for c in features.CLASSICAL)


@dataclass(frozen=True)
class Config:
    """``run_dir`` is absolute: a path from the root or with a scheme, on a store that all executors reach."""

    run_dir: str
    mode: str = "quick"
    target: str = canonical.TARGET

    def __post_init__(self):
        if not (self.run_dir.startswith("/") or "://" in self.run_dir):
            raise ValueError("the run folder must be absolute")
        if self.mode not in regress.SPACES:
            raise ValueError(f"unknown mode {self.mode!r}")

    def at(self, *parts: str) -> str:
        return "/".join((self.run_dir.rstrip("/"), *parts))


def clean(raw: DataFrame, version: str, config: Config) -> str:
    """Canonical rows and their audit, published as one stage."""
    spark = raw.sparkSession
    rows, audit = canonical.canonicalize(raw, version)

    def write(at: str) -> None:
        rows.write.parquet(f"{at}/rows")
        publish.write_json(spark, f"{at}/audit.json", {"version": version, "counts": [r.asDict() for r in audit.collect()]})

    return publish.publish(spark, config.at("clean"), write)


def split_stage(rows: DataFrame, config: Config) -> str:
    """Chronological split with features fitted on training rows, partitioned by part, and its manifest.

    The rows must keep the contract of canonical rows.
    """
    spark = rows.sparkSession
    version = rows.agg(F.min("dataset_version")).first()[0]
    contracts.require(contracts.canonical(rows, version))
    p = stage(split.chronological(rows))
    split.require_parts(split.boundaries(p))
    x, imputer, scaler = features.classical_features(p)

    def write(at: str) -> None:
        x.write.partitionBy("split").parquet(f"{at}/rows")
        contracts.part_summary(p).write.parquet(f"{at}/manifest")
        publish.write_json(spark, f"{at}/fit.json", {"fills": imputer.fills, "standard": scaler.stats})

    return publish.publish(spark, config.at("split"), write)


def train(spark: SparkSession, config: Config, candidates: tuple[str, ...] = ("ridge", "random_forest", "gradient_boosting", "gradient_boosting_deep")) -> str:
    """All candidates searched on training rows, scored on validation rows, published together.

    The saved split must keep its contract. A candidate is its model, its
    validation predictions and the metrics it claims.
    """
    path = config.at("split", "rows")
    parts = spark.read.parquet(path)
    contracts.require(contracts.saved_split(parts, spark.read.parquet(config.at("split", "manifest")), [*Z, config.target]))
    tr, va = (regress.assembled(scan.partition(spark, path, p), Z) for p in ("train", "validation"))
    if config.mode == "quick":
        tr = split.capped_sample(tr.drop("rn", "n"), 1000)
    tr = stage(tr)

    def write(at: str) -> None:
        board = []
        for name in candidates:
            model, best, tried = regress.search(name, config.mode, tr, va, config.target)
            PipelineModel([model]).save(f"{at}/{name}/model")
            scored = stage(_scored(model, va, config))
            scored.select("record_id", "p").write.parquet(f"{at}/{name}/predictions")
            metrics.grouped_metrics(scored, ["vessel_id"]).write.parquet(f"{at}/{name}/metrics")
            publish.write_json(spark, f"{at}/{name}/search.json", {"best": best, "trials": tried})
            board.append((name, float(best["mae"])))
        ranked = metrics.leaderboard(spark.createDataFrame(board, "candidate string, mae double"), list(candidates))
        publish.write_json(spark, f"{at}/leaderboard.json", {"rows": [r.asDict() for r in ranked.orderBy("rank").collect()]})

    return publish.publish(spark, config.at("candidates"), write)


def _scored(model, rows: DataFrame, config: Config) -> DataFrame:
    return model.transform(rows).select("record_id", "vessel_id", F.col(config.target).alias("y"), F.col("prediction").alias("p"))


def verify(spark: SparkSession, config: Config, name: str) -> None:
    """Raise unless a candidate keeps its contract: predictions whole and finite, metrics as claimed, the same from the reloaded model."""
    at = config.at("candidates", name)
    va = regress.assembled(scan.partition(spark, config.at("split", "rows"), "validation"), Z)
    again = stage(_scored(PipelineModel.load(f"{at}/model"), va, config))
    saved, claimed = spark.read.parquet(f"{at}/predictions"), spark.read.parquet(f"{at}/metrics").drop("is_total")
    contracts.require(contracts.candidate(saved, again.select("record_id", "vessel_id", "y"), claimed, again=again))


def verify_in_fresh_process(config: Config, name: str, timeout: float = 600.0) -> None:
    """``verify`` in a process of its own, so that nothing of the training session can help the candidate."""
    done = subprocess.run([sys.executable, "-m", "tidewright", "verify", "--run-dir", config.run_dir, "--candidate", name], capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"{name} does not hold in a fresh process")


def select(spark: SparkSession, config: Config) -> str:
    """Freeze the best candidate by validation error, once all of them keep their contract; test rows are not touched."""
    rows = publish.read_json(spark, config.at("candidates", "leaderboard.json"))["rows"]
    names = [r["candidate"] for r in rows]
    if not names or len(set(names)) != len(names):
        raise ValueError("the leaderboard needs each candidate once")
    for name in names:
        verify(spark, config, name)
    champion = metrics.champion(spark.createDataFrame([(r["candidate"], float(r["mae"])) for r in rows], "candidate string, mae double"))
    chosen = {"champion": champion, "candidates": sorted(names), "config": asdict(config)}
    return publish.publish(spark, config.at("champion"), lambda at: publish.write_json(spark, f"{at}/selection.json", chosen))


def evaluate(spark: SparkSession, config: Config) -> dict:
    """The one test of the frozen champion; a second one is refused.

    The test is claimed before a test row is read, so a run that broke off
    cannot be repeated either.
    """
    chosen = publish.read_json(spark, config.at("champion", "selection.json"))
    publish.claim(spark, config.at("test-claimed"))
    chosen["test_used"] = publish.exists(spark, config.at("test"))
    test = regress.assembled(scan.frozen_test(spark, config.at("split", "rows"), chosen), Z)
    scored = stage(_scored(PipelineModel.load(config.at("candidates", chosen["champion"], "model")), test, config))
    metrics.require_finite(scored)
    by = [r.asDict() for r in metrics.grouped_metrics(scored, ["vessel_id"]).collect()]

    def write(at: str) -> None:
        scored.write.parquet(f"{at}/predictions")
        publish.write_json(spark, f"{at}/metrics.json", {"champion": chosen["champion"], "metrics": by})

    publish.publish(spark, config.at("test"), write)
    publish.switch(spark, config.run_dir.rstrip("/"), {"champion": config.at("champion"), "test": config.at("test")})
    return next(r for r in by if r["is_total"])


def predict(spark: SparkSession, config: Config, rows: DataFrame, key: str = "record_id") -> DataFrame:
    """Predictions of the frozen champion for rows of a key and exactly the six raw features, null or NaN but not infinite.

    Every row is answered once, with a finite number.
    """
    contracts.require(contracts.inference_input(rows.drop(key)))
    fit = publish.read_json(spark, config.at("split", "fit.json"))
    name = publish.read_json(spark, config.at("champion", "selection.json"))["champion"]
    x = features.encoded_direction(features.Imputer(fit["fills"]).transform(rows))
    x = features.Standardizer({c: tuple(v) for c, v in fit["standard"].items()}).transform(x)
    out = PipelineModel.load(config.at("candidates", name, "model")).transform(regress.assembled(x, Z)).drop("features")
    contracts.require(contracts.inference_output(rows, out, key))
    return out
