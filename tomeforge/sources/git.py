"""Exported version-control text as tables: commit logs, diff hunks, quoted paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex, pr_hints

ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def unquoted(path: str) -> str:
    """A C-quoted path as it is; paths without quotes stay."""
    if len(path) < 2 or not (path.startswith('"') and path.endswith('"')):
        return path
    out, body, i = bytearray(), path[1:-1], 0
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode()
            i += 1
        elif octal := re.match(r"[0-3][0-7]{2}", body[i + 1 :]):
            out.append(int(octal[0], 8))
            i += 4
        else:
            out.append(ESCAPES.get(body[i + 1 : i + 2], ord(body[i + 1 : i + 2] or "\\")))
            i += 2
    return out.decode("utf-8", "replace")


def commits(logs: DataFrame, scope: str, log: str = "log", mark: str = "\x01", most_paths: int = 20) -> DataFrame:
    """One row per commit from exported logs.

    Commits are opened by ``mark``; their fields, revision, parents, author, epoch seconds and
    message, end with NUL, and the affected paths follow, one a line.
    """
    one = logs.select(F.explode(F.split(log, mark)).alias("c")).where(F.contains("c", F.lit("\0")))
    f = lambda i: F.get(F.split("c", "\0"), i)
    paths = F.filter(F.split(F.coalesce(f(5), F.lit("")), "\n"), lambda p: p != "")
    return one.select(
        F.concat(F.lit("hist-"), F.sha2(F.concat(F.lit(scope + "\n"), F.trim(f(0))), 256)).alias("item_id"),
        F.trim(f(0)).alias("revision_id"),
        F.filter(F.split(f(1), " "), lambda p: p != "").alias("parents"),
        f(2).alias("author"),
        (f(3).cast("long") * 1000).alias("committed_at_ms"),
        f(4).alias("message"),
        F.slice(paths, 1, most_paths).alias("affected_paths"),
        F.greatest(F.size(paths) - most_paths, F.lit(0)).alias("paths_truncated"),
        pr_hints(f(4)).alias("pr_hint"),
    )


HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)")
HUNKS = "path string, old_start int, old_lines int, new_start int, new_lines int, context string"


def hunks_of(diff: str) -> Iterator[tuple]:
    """Hunks of a unified diff; body lines are counted down, so text that looks like a header is none."""
    path, old, new = "", 0, 0
    for line in diff.split("\n"):
        if old > 0 or new > 0:
            old -= line[:1] in (" ", "-", "")
            new -= line[:1] in (" ", "+", "")
        elif line.startswith("+++ "):
            name = unquoted(line[4:].split("\t")[0])
            path = path if name == "/dev/null" else name.removeprefix("b/")
        elif line.startswith("--- "):
            path = unquoted(line[4:].split("\t")[0]).removeprefix("a/")
        elif m := HUNK.match(line):
            a, b, c, d = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            old, new = b, d
            yield path, a, b, c, d, m[5][:80]


def hunks(diffs: DataFrame, key: str, diff: str, most: int = 20) -> DataFrame:
    """(key, hunk fields, ord) for each commit's diff, at most ``most``."""
    kind = diffs.schema[key].dataType.simpleString()

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *h, i) for k, d in frame.itertuples(index=False) for i, h in enumerate(list(hunks_of(d or ""))[:most])]
            yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in HUNKS.split(", ")), "ord"])

    return diffs.select(key, diff).mapInPandas(apply, f"{key} {kind}, {HUNKS}, ord int")


def touches(paths: Column, pattern: str) -> Column:
    """Whether any affected path matches a glob whose * and ? cross separators."""
    return F.exists(paths, lambda p: p.rlike(glob_regex(pattern)))
