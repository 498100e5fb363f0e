"""The session the tests and the bench use, and the table reader every query shares."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tomeforge", **extra: str) -> SparkSession:
    """A local session with AQE, UTC and few shuffle partitions; a cluster brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("TOMEFORGE_DRIVER_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. The path goes to Spark's reader as it is, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
