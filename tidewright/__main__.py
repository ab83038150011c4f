"""Stages from the command line: python -m tidewright STAGE --run-dir DIR [...]"""

from __future__ import annotations

import argparse

from tidewright.plans import pipeline
from tidewright.session import local_session
from tidewright.sources import scan


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidewright")
    p.add_argument("stage", choices=("ingest", "clean", "split", "train", "verify", "select", "evaluate"))
    p.add_argument("--run-dir", required=True)
    p.add_argument("--mode", choices=("quick", "normal"), default="quick")
    p.add_argument("--source", help="raw CSV snapshot (clean); folder with one Parquet folder an entity (ingest)")
    p.add_argument("--version", help="forty hexadecimal digits (ingest, clean)")
    p.add_argument("--entities", nargs="+", default=[], help="entities in order (ingest)")
    p.add_argument("--candidate", help="candidate (verify)")
    a = p.parse_args(argv)
    config, spark = pipeline.Config(a.run_dir, a.mode), local_session()
    if a.stage == "ingest":
        print(scan.ingest(spark, a.source, a.entities, a.version, config.at("raw")))
    elif a.stage == "clean":
        print(pipeline.clean(scan.raw_csv(spark, a.source) if a.source else spark.read.parquet(config.at("raw", "rows")), a.version, config))
    elif a.stage == "split":
        print(pipeline.split_stage(spark.read.parquet(config.at("clean", "rows")), config))
    elif a.stage == "train":
        print(pipeline.train(spark, config))
    elif a.stage == "verify":
        pipeline.verify(spark, config, a.candidate)
    elif a.stage == "select":
        print(pipeline.select(spark, config))
    else:
        print(pipeline.evaluate(spark, config))


if __name__ == "__main__":
    main()
