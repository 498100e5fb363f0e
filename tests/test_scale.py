"""Interval joins, order statistics and throttles: against brute force, and at sizes where pairs would not end."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tomeforge.operators import enrichment, graph, intervals, selection, throttle


def test_blocks_make_up_intervals(spark):
    some = [(a, b) for a in range(0, 40) for b in range(a, 40)] + [(3, 2), (0, 2**31 - 1), (7, 2**31 - 1), (2**31 - 1, 2**31 - 1)]
    for r in spark.createDataFrame(some, "a int, b int").select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("x")).collect():
        ranges = sorted((n.at << n.k, (n.at + 1 << n.k) - 1) for n in r.x)
        assert len(ranges) <= 62 and all(q[0] == p[1] + 1 for p, q in zip(ranges, ranges[1:]))
        assert (ranges[0][0], ranges[-1][1]) == (r.a, r.b) if r.a <= r.b else not ranges


def test_first_cover_by_brute_force(spark):
    rng = random.Random(3)
    chunks = [(f"p{rng.randrange(3)}", a, a + rng.randrange(-1, 30), k, f"c{k}") for k in range(300) for a in [rng.randrange(1, 200)]]
    points = [(f"p{rng.randrange(4)}", f"r{k}", rng.choice([None, rng.randrange(0, 230)])) for k in range(400)] + [(None, "none", 3), ("p0", "r0", 5)]
    got = graph.covering_chunk(spark.createDataFrame(points, "path string, ref_id string, line int"), spark.createDataFrame(chunks, "path string, line_start int, line_end int, ord int, chunk_id string"))
    want = [(p, r, n, min(((o, c) for q, a, b, o, c in chunks if q == p and n is not None and a <= n <= b), default=(0, None))[1]) for p, r, n in points]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    named = [(p, rng.choice("xy"), a, o, c) for p, a, _, o, c in chunks]
    asked = [(r, p, rng.choice("xyz"), n) for p, r, n in points if n is not None]
    got = graph.local_symbols(spark.createDataFrame(asked, "ref_id string, path string, name string, line int"), spark.createDataFrame(named, "path string, name string, line_start int, ord int, symbol_id string"))
    want = [(r, p, x, n, min(((d > n, o, s) for q, y, d, o, s in named if (q, y) == (p, x)), default=(0, 0, None))[2]) for r, p, x, n in asked]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_path_of_many_chunks_and_points(spark):
    """100,000 nested intervals and points of one path: 10^10 pairs, and none of them is made."""
    n = 100_000
    chunks = spark.range(n).selectExpr("'p' as path", "cast(id + 1 as int) as line_start", "cast(2 * id + 10 as int) as line_end", "cast(id as int) as ord", "concat('c', id) as chunk_id")
    points = spark.range(n).selectExpr("'p' as path", "concat('r', id) as ref_id", "cast(id * 2 + 1 as int) as line")
    began = time.monotonic()
    found = graph.covering_chunk(points, chunks).agg(F.count("chunk_id").alias("n"), F.sum(F.substring("chunk_id", 2, 9).cast("long")).alias("s")).first()
    firsts = [max(0, math.ceil((line - 10) / 2)) for line in range(1, 2 * n, 2)]
    good = [f for f, line in zip(firsts, range(1, 2 * n, 2)) if f < n and f + 1 <= line]
    assert (found.n, found.s) == (len(good), sum(good))
    same = spark.range(n).selectExpr("concat('r', id) as ref_id", "'p' as path", "'f' as name", "cast(id as int) as line")
    symbols = spark.range(n).selectExpr("'p' as path", "'f' as name", "cast(id + 1 as int) as line_start", "cast(id as int) as ord", "concat('s', id) as symbol_id")
    assert graph.local_symbols(same, symbols).where("symbol_id = 's0'").count() == n
    assert time.monotonic() - began < 60


def test_intervals_alike_are_cut_into_blocks_once(spark):
    """5,000 symbols of two lines make a few blocks, not some thirty each: these would be sorted by the task of one small file."""
    symbols = spark.range(5000).selectExpr("'p' as path", "'f' as name", "cast(id % 2 * 8 + 1 as int) as line_start", "cast(5000 - id as int) as ord", "concat('s', id) as symbol_id")
    refs = spark.createDataFrame([("above", "p", "f", 3), ("both", "p", "f", 9), ("below", "p", "f", 0), ("none", "p", "g", 3)], "ref_id string, path string, name string, line int")

    def cut(node):
        children = node.children()
        below = sum(cut(children.apply(i)) for i in range(children.size()))
        return below + (node.metrics().apply("numOutputRows").value() if node.nodeName() == "Generate" else 0)

    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = graph.local_symbols(refs, symbols)
        assert {r.ref_id: r.symbol_id for r in found.collect()} == {"above": "s4998", "both": "s4999", "below": "s4999", "none": None}
        assert 0 < cut(found._jdf.queryExecution().executedPlan()) < 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_percentiles_by_brute_force(spark, kind):
    rng = random.Random(5)
    make = {"double": lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e300), 0.5, float("nan"), None, -0.25, 1e-300]), "long": lambda: rng.choice([rng.randrange(10**18), 7, None, -3])}[kind]
    rows = [(g, make()) for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 5000), (None, 3)) for _ in range(n)] + [("e", None)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    got = {r.g: (r.lo, r.near, r.mid) for r in selection.percentiles(df, ["g"], "v", {"lo": ("floor", 95), "near": ("nearest", 95), "mid": ("nearest", 50)}).collect()}
    for g in "abcd":
        v = sorted(x for h, x in rows if h == g and x is not None and not math.isnan(x))
        if v:
            at = lambda k: v[max(k, 0)]
            assert got[g] == (at(math.floor(0.95 * (len(v) - 1))), at(math.ceil(0.95 * len(v)) - 1), at(math.ceil(0.5 * len(v)) - 1)), g
    assert "e" not in got or got["e"] == (None, None, None)
    assert selection.percentiles(df.limit(0), ["g"], "v", {"lo": ("floor", 95)}).count() == 0


def test_percentiles_gather_no_group(spark):
    df = spark.range(300_000).selectExpr("'g' as g", "pmod(id * 7919, 300007) as v")
    found = selection.percentiles(df, ["g"], "v", {"p": ("nearest", 50)})
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert found.first().p == sorted(i * 7919 % 300007 for i in range(300_000))[150_000 - 1]


def plain_throttle(rows, gap):
    out, by = [], {}
    for i, u, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        by.setdefault(u, []).append((i, t))
    for events in by.values():
        last = None
        for i, t in events:
            if last is None or t - last >= gap:
                out.append(i)
                last = t
        if out[-1] != events[-1][0]:
            out.append(events[-1][0])
    return sorted(set(out))


def test_throttle_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, f"u{rng.choice([0, 0, 0, 1, 2])}", rng.choice([None, rng.randrange(3000), rng.randrange(10**9)])) for i in range(1500)]
    rows += [(2000 + i, "dense", i) for i in range(700)] + [(3000 + i, "sparse", i * 1000) for i in range(40)] + [(4000, "one", 5), (4001, "same", 5), (4002, "same", 5)]
    got = throttle.throttled(spark.createDataFrame(rows, "event_id long, user string, at long").repartition(4), "user", "at", 10, "event_id")
    assert sorted(r.event_id for r in got.collect()) == plain_throttle(rows, 10)
    assert throttle.throttled(got.limit(0), "user", "at", 10, "event_id").count() == 0


def plain_report(rows, most_items, most_requests):
    out = {}
    for scope in {r[0] for r in rows}:
        items = sorted((k, o, r or 0) for s, k, o, r in rows if s == scope)
        left, a = most_requests, dict.fromkeys(("attempted", "enriched", "no_association", "failed", "rate_limited", "permission_denied", "budget_exhausted"), 0)
        for _, o, r in items:
            if a["attempted"] >= most_items:
                break
            if left == 0:
                a["budget_exhausted"] = True
                break
            a["attempted"] += 1
            if r > left:
                left, o = 0, "budget_exhausted"
            left -= min(r, left)
            if o in ("rate_limited", "permission_denied", "budget_exhausted"):
                a[o] = True
                break
            a[{"verified": "enriched", "no_association": "no_association"}.get(o, "failed")] += 1
        out[scope] = (len(items), *a.values(), len(items) - a["attempted"])
    return out


def test_asking_stops_like_a_loop(spark):
    rng = random.Random(2)
    outcomes = ["verified"] * 8 + ["no_association"] * 6 + ["odd", None, "rate_limited", "permission_denied", "budget_exhausted"]
    rows = [(f"s{s}" if s else None, k, rng.choice(outcomes[: rng.choice([14, 16, 19])]), rng.choice([None, 0, 1, 1, 2, 5])) for s in range(60) for k in range(rng.choice([1, 3, 12, 40]))]
    df = spark.createDataFrame(rows, "scope string, k int, outcome string, requests int").repartition(4)
    for most_items, most_requests in ((10, 8), (3, 100), (25, 0)):
        got = enrichment.report(df, "scope", "k", "outcome", "requests", most_items, most_requests)
        assert {r[0]: tuple(r)[1:] for r in got.where("scope is not null").collect()} == {s: v for s, v in plain_report(rows, most_items, most_requests).items() if s is not None}
    assert enrichment.report(df.limit(0), "scope", "k", "outcome", "requests", 3, 3).count() == 0
