"""What the jobs share: settings, the session of a command line, log, and where a query's run may write."""

from __future__ import annotations

import argparse
import json
import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def settings(name: str, path: str | None = None) -> dict:
    """The settings beside the job, with those of another file over them; unknown names are refused."""
    with open(os.path.join(HERE, f"{name}.json")) as f:
        out = json.load(f)
    if path:
        with open(path) as f:
            over = json.load(f)
        if unknown := set(over) - set(out):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= over
    return out


def command(name: str, work: Callable[[SparkSession, argparse.Namespace, dict], object], paths: dict[str, str]) -> None:
    """Run ``work`` with a session of its own; ``paths`` are the job's arguments and what they mean."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for path, meaning in paths.items():
        parser.add_argument(f"--{path}", required=True, help=meaning)
    parser.add_argument("--config", help=f"a JSON file over {name}.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, args, settings(name, args.config))
    finally:
        spark.stop()


def written(spark: SparkSession, path: str, schema: str | None = None, format: str = "parquet") -> DataFrame | None:
    """A table written before, or None where there is none yet."""
    reader = spark.read.format(format)
    try:
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one that the session names."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="jobs-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"
