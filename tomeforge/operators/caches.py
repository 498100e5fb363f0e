"""Content-addressed caches: lookups, upserts, references, and calls of an embedding provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .experiments import batches
from .vectors import valid

# Sizes and waits of provider calls.
BATCH, RETRIES, FIRST_WAIT_S, LAST_WAIT_S = 32, 2, 0.25, 5.0


def cache_key(input_hash: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws("\n", input_hash, fingerprint), 256)


def fingerprint(version: str, provider: str, model: str, dimension: int, profile: str) -> str:
    return f"emb-v{version}|{provider}|{model}|dim={dimension}|input={profile}"


def templated(profile: str, kind: str, title: Column, text: Column) -> Column:
    """What is embedded for a document, code or query, by input profile."""
    if profile == "raw":
        return text
    if kind == "query":
        return F.concat(F.lit("task: search result | query: "), text)
    return F.concat(F.lit("title: "), F.when(title != "", title).otherwise("none"), F.lit(" | text: "), text)


def looked_up(requests: DataFrame, cache: DataFrame, dimension: int) -> DataFrame:
    """``requests`` (cache_key, ...) with ``vector``; null where the cache has none or a broken one."""
    good = cache.where(valid(F.col("vector"), dimension)).select("cache_key", "vector")
    return requests.join(good, "cache_key", "left")


def upserted(cache: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one of the highest ``order``; of equals the new one."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def referenced(members: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that any member of a family refers to."""
    return reduce(DataFrame.unionByName, [m.select(*keys) for m in members]).distinct()


def embedded(chunks: DataFrame, provider: Callable[[list[str]], list[list[float] | None]], dimension: int, batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """``chunks`` (cache_key, text) with ``vector`` from a provider, called with ``batch`` texts at a time.

    A call that fails is tried again after a growing wait; texts whose call keeps failing, or
    whose vector is not valid, have null and stay pending. Nothing is filled with zeros.
    """

    def call(texts: list[str]) -> list:
        wait = FIRST_WAIT_S
        for attempt in range(retries + 1):
            try:
                found = provider(texts)
                if len(found) != len(texts):
                    raise ValueError("one vector a text is expected")
                return found
            except Exception:  # a provider may fail in any way; what it did not answer stays pending
                if attempt < retries:
                    time.sleep(wait)
                    wait = min(2 * wait, LAST_WAIT_S)
        return [None] * len(texts)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, batch):
            yield pd.DataFrame({"cache_key": part["cache_key"], "vector": call(part["text"].tolist())})

    found = chunks.select("cache_key", "text").mapInPandas(apply, "cache_key string, vector array<float>")
    return found.withColumn("vector", F.when(valid(F.col("vector"), dimension), F.col("vector")))
