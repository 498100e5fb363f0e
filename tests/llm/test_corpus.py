"""Operators that compare documents with each other, against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash

from tomeforge.llm import chat, embedding, mixing, queries, shingles, simhash, substring
from tomeforge.llm.common import connected_components
from tests.test_jobs import shuffled


def parts_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (1, 2), (2, 1)]
    want = parts_of(400, links)
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 64])
def test_components_of_more_links_than_one_task_joins(spark, most):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(999, 400 + i) for i in range(30)]
    want = parts_of(1000, links)
    got = collections.Counter(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long").repartition(5), most).collect()))
    assert got == collections.Counter((i, want[i]) for i in {x for a, b in links if a != b for x in (a, b)})


def tasks_of(spark):
    """How many tasks all stages so far have run."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    scala = context._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    stages = scala.statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).numCompleteTasks() for i in range(stages.size()))


def test_few_links_in_many_partitions_take_few_tasks(spark):
    """Each task leaves files and a record of itself, however few rows it has."""
    nodes = np.random.default_rng(4).permutation(2000).tolist()
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long").repartition(40)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        before = tasks_of(spark)
        got = connected_components(links).collect()
        tasks = tasks_of(spark) - before
    finally:
        spark.conf.set(name, was)
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, 0) for i in nodes)
    assert tasks < 150, tasks


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_all_pairs(ids, fps):
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    part = parts_of(len(fps), links)
    low = {}
    for i, p in zip(ids, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return [low.get(p) for p in part]


def test_simhash_documents(spark, edge, empty, sf):
    docs = edge.select("doc_id", "text", "id").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = collections.Counter(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], components_by_all_pairs([i for i, _ in rows], fps)))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert queries.op6_simhash(spark, sf).columns == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("most", [4096, 7])
def test_links_lose_none(spark, most):
    """Clusters of close fingerprints, also where every cell is cut into blocks."""
    rng = np.random.default_rng(2)
    fps = set()
    for base in [0, (1 << 64) - 1, *map(int, rng.integers(0, 1 << 63, 6))]:
        for _ in range(25):
            f = base
            for b in rng.integers(0, 64, int(rng.integers(0, 7))):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    at = {f: i for i, f in enumerate(fps)}
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = [(at[a % (1 << 64)], at[b % (1 << 64)]) for a, b in simhash.linked(signed, most=most).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in found)
    exact = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert parts_of(len(fps), found) == parts_of(len(fps), exact)


def test_first_of_each(spark, edge, empty):
    kept = simhash.first_of_each(edge)
    assert kept.columns == edge.columns
    texts = collections.Counter(r.text for r in kept.collect())
    assert texts["Same text here, said twice over by two documents in all."] == 1
    assert sum(texts[t] for t in (None, "", " \t\n")) == 1  # all without words link
    assert texts["a repeated id"] == texts["a null id"] == 1
    assert simhash.first_of_each(empty).count() == 0


def test_first_of_each_shuffles_few_texts(spark):
    """Where few rows go, the texts of the others stay where they are, also when their keys are too many for a broadcast."""
    texts = [" ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(300)) for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[7]), (201, texts[9]), (3, texts[3]), (None, "no id")], "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        kept = simhash.first_of_each(docs).collect()
        written = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert collections.Counter(map(tuple, kept)) == collections.Counter([*enumerate(texts), (None, "no id")])
    assert written < sum(map(len, texts)) // 4  # half a byte a hexadecimal digit, were all of it packed well


@pytest.mark.parametrize("groups", [5, 8, 9])
def test_any_number_of_groups_loses_no_link(spark, groups):
    rng = np.random.default_rng(3)
    fps = []
    for base in map(int, rng.integers(0, 1 << 63, 40)):
        fps += [base, base ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))]
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {frozenset((a % (1 << 64), b % (1 << 64))) for a, b in simhash.linked(signed, groups=groups).collect()}
    assert found == {frozenset(fps[i : i + 2]) for i in range(0, 80, 2)}


def test_grids_grow_with_the_table():
    """Comparisons a fingerprint stay few: rows in grids and partners in cells, from thousands to ten thousand million."""
    for n in (10**4, 10**6, 10**8, 10**10):
        g = simhash.plan_groups(n, 4)
        assert math.comb(g, 4) * n * simhash.ALIKE ** (32 * (g - 4) / g) < 20_000, (n, g)


# embeddings


def by_all_pairs(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for g, (_, v) in zip(good, rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if good[i] and good[j] and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or float(unit[i] @ unit[j]) >= threshold)]
    degree = collections.Counter(x for pair in links for x in pair)
    part = parts_of(len(rows), links)
    low = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return collections.Counter((i, degree[k], low.get(p), i is not None and i == low.get(p)) for k, ((i, _), p) in enumerate(zip(rows, part)))


@pytest.mark.parametrize("most", [4096, 9])
def test_embedding_links(spark, most):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        rows += [[len(rows) + k, (base + rng.standard_normal(16) * s).astype("f4").tolist()] for k, s in enumerate([0, 0.1, 0.15, 0.2, 0.25])]
    rows += [[len(rows) + k, rows[3][1]] for k in range(30)]  # a hot vector
    rows += [[900, None], [901, [0.0] * 16], [902, [float("nan")] * 16], [903, [None] * 16], [904, [float("inf")] * 16], [905, []], [906, [1.0, 2.0]], [907, [2.0, 4.0]], [None, rows[0][1]], [7, rows[5][1]], [908, [1e-30] * 16], [909, [1e30] * 16]]
    rows = [tuple(r) for r in rows]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, class string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = collections.Counter(map(tuple, embedding.near_duplicates(vectors, miss=1e-12, most=most).collect()))
    assert got == by_all_pairs(rows)
    assert embedding.near_duplicates(vectors.limit(0)).count() == 0


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert collections.Counter(map(tuple, queries.op1_embedding(spark, sf).collect())) == by_all_pairs(rows)


def test_tables_keep_the_miss_rate():
    for n in (100, 10_000, 10**7, 10**10):
        bits, tables = embedding.plan_tables(n, 0.9, 1e-4)
        agree = 1 - math.acos(0.9) / math.pi
        assert (1 - agree**bits) ** tables <= 1e-4


# repeated passages


def plain_units(text, cut):
    at = 0
    for unit in re.split(cut, text or ""):
        yield at, at + len(unit), re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", unit.lower()).strip()
        at += len(unit)


@pytest.mark.parametrize("unit", ["line", "sentence"])
def test_repeats(spark, edge, empty, sf, unit):
    docs = edge.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    cut = {"line": r"(?<=\n)", "sentence": r"(?<=\n)|(?<=[.!?])(?=[ \t])"}[unit]
    seen = collections.defaultdict(set)
    for i, t in docs.collect():
        for a, b, norm in plain_units(t, cut):
            if len(norm.split()) >= 8:
                seen[norm].add((i is not None, i or 0, a, b))
    want = {(i, a, b, len(norm.split()), min(places)[1], min(places)[2]) for norm, places in seen.items() for _, i, a, b in places if (i, a) != min(places)[1:3]}
    got = substring.repeats(docs, unit=unit)
    assert set(map(tuple, got.collect())) == want
    assert substring.repeats(empty).count() == 0


def test_cut_passages_keep_their_places(spark):
    shared = "This passage of many words is the same in two of the documents here."
    docs = spark.createDataFrame([(1, f"Alone. {shared} End."), (2, f"{shared} Other é end."), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(s) for s in r.kept_spans]) for r in substring.without_repeats(docs).collect()}
    assert got == {1: (f"Alone. {shared} End.", [(0, 7 + len(shared) + 5)]), 2: (" Other é end.", [(len(shared), len(shared) + 13)]), 3: (None, []), 4: ("", [])}


def test_passages_wherever_they_start(spark):
    """Words of repeated windows against brute force, and passages that whole sentences lose."""
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    shared, texts = [fresh(120) for _ in range(3)], {}
    for i in range(24):
        a, n = int(rng.integers(0, 30)), int(rng.integers(50, 91))
        texts[i] = fresh(int(rng.integers(0, 40))) + shared[i % 3][a : a + n] + fresh(int(rng.integers(1, 40)))
    texts[24] = texts[5]
    first, want = {}, collections.defaultdict(set)
    for i, w in sorted(texts.items()):
        for k in range(len(w) - 49):
            if (key := tuple(w[k : k + 50])) in first and first[key] != (i, k):
                want[i] |= set(range(k, k + 50))
            first.setdefault(key, (i, k))
    want[24] = set(range(len(texts[24])))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in substring.repeats(docs, min_words=10**6).collect():
        text = " ".join(texts[r.doc_id])
        a = len(text[: r.start].split())
        got[r.doc_id] |= set(range(a, a + len(text[r.start : r.end].split())))
    assert {i: (sorted(want[i] - got[i]), sorted(got[i] - want[i])) for i in texts if got[i] != want[i]} == {} and len(want) > 5

    short = "Go on. Stay there now. We saw it. All is well."
    odd = "one two three four five.### six seven eight nine ten"
    han = "".join(chr(0x4E00 + x) for x in range(20))
    pairs = [(1, f"Alpha first. {short} Other end."), (2, f"Beta begins. {short} More of it."), (3, f"{odd}\nx"), (4, "one two three four five. six seven eight nine ten\ny"), (5, f"{han}\nz"), (6, f"{han}\nq"), (7, "Ha. " * 40)]
    left = {r.doc_id: r.text for r in substring.without_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert {k: left[k] for k in (1, 3, 5)} == {k: t for k, t in pairs if k in (1, 3, 5)}
    assert (left[2], left[4], left[6]) == ("Beta begins. More of it.", "y", "q") and left[7].split() == ["Ha."] * 8


def plain_words(text):
    """(word, start, end) of a text: runs of letters and digits and of other signs beyond ASCII; Han characters one by one."""
    pattern = "[\u4e00-\u9fff]|[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x85\xa0\u2000-\u200b\u2028\u2029\u3000\u4e00-\u9fff]+"
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(pattern, text or "")]


@pytest.mark.parametrize("most", [4096, 3])
def test_lines_and_windows_by_brute_force(spark, edge, sf, most):
    """Words in repeated lines of 8 words, in whole copies, and in repeated windows of 50, also where all anchors are hot."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"q{x}" for x in rng.integers(0, 10**9, n)]
    shared = fresh(90)
    made = [(5000 + i, " ".join(fresh(i) + shared[i % 7 : 60 + i % 20] + fresh(9))) for i in range(12)]
    long = [f"{'z' * 40000}{k}" for k in range(3)]
    made += [(6000 + i, " ".join(fresh(i + 1) + long + shared[:20] + long + shared[20:60] + fresh(3))) for i in range(3)]
    made += [(7000, "\n".join([" ".join(shared)] * 3)), (7001, "x\n" + " ".join(shared[:30]) + "\ny"), (7002, "w\n" + " ".join(shared[:30]).upper() + "!\nz")]
    docs = edge.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    cut = [plain_words(t) for _, t in rows]
    units = collections.defaultdict(list)
    for k, ((i, t), w) in enumerate(zip(rows, cut)):
        words, starts = [x for x, *_ in w], [a for _, a, _ in w]
        ranges = {(0, len(w))} if len(w) >= 8 else set()
        ends = [np.searchsorted(starts, m.end()) for m in re.finditer("\n", t or "")]
        ranges |= {(a, b) for a, b in zip([0, *ends], [*ends, len(w)]) if b - a >= 8} | {(a, a + 50) for a in range(len(w) - 49)}
        for a, b in ranges:
            units[tuple(words[a:b]), b - a == 50].append((i is not None, i or 0, a, k))
    want = collections.defaultdict(set)
    for (words, _), places in units.items():
        first = min(places)
        for some, i, a, k in places:
            if (some, i) != first[:2] or a >= first[2] + len(words):
                want[rows[k]] |= {(cut[k][j][1], cut[k][j][2]) for j in range(a, a + len(words))}
    got = collections.defaultdict(set)
    found = substring.repeated_passages(docs, "doc_id", "text", False, 8, most).collect()
    ids = collections.Counter(i for i, _ in set(rows))
    words_of = {row[0]: (row, w) for row, w in zip(rows, cut) if ids[row[0]] == 1}
    for r in found:
        if r.doc_id in words_of:
            row, w = words_of[r.doc_id]
            inside = [(a, b) for _, a, b in w if a >= r.start and b <= r.end]
            assert len(inside) == r.n_words
            got[row] |= set(inside)
    for row, _ in words_of.values():
        assert got[row] == want[row], row[0]
    assert len(found) < 2000  # a text of one word over and over is one passage
    assert sum(map(len, want.values())) > 5000
    assert queries.op2_substring(spark, sf).columns == ["doc_id", "start", "end", "n_words", "first_id", "first_start"]


# chats


def digests(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), loss


def test_chats_read_back(spark):
    hostile = ["<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_sep|>", "<\\\\|", "<|", "\n", "", None, "a<|im_end|>\n", "$1\\", "é\n\n"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "r\n<|x"][(c + t) % 5], hostile[(3 * c + t) % len(hostile)], 9) for c in range(12) for t in range(7)]
    rows += [(None, 1, "user", "null id", 9), (50, None, "assistant", "null turn", 9), (50, 0, "user", "x", 9), (51, 1, "assistant", "one number", 9), (51, 1, "assistant", "one number", 9)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    by = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    for r in chat.read_back(chat.formatted(chats)).collect():
        assert [tuple(t) for t in r.turns] == by[r.conv_id]
        assert r.loss == digests(by[r.conv_id])[1]
    assert chat.formatted(chats.limit(0)).count() == 0


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in queries.op3_chat(spark, sf).collect()}
    by = collections.defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        by[r.conv_id].append((r.role, r.text))
    text = "<|im_end|><|im_start|>assistant ok"
    by[-1] = [("user", text), ("assistant", text)]
    assert set(got) == set(by)
    for c, turns in by.items():
        sha, loss = digests(turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())


# mixing


def shares(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > most * sizes[s] and s not in stopped}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 300}, {"a": 1, "b": 2, "c": 3, "d": 5000}, {"a": 0, "b": 0}, {None: 7}, {"z": 100, "é": 100, "日": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = shares(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert got == pytest.approx(want)


def test_mix_reaches_its_targets(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mixed(docs).collect()
    taken, size = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r.size
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    want = shares(size)
    assert all(abs(taken[s] - want[s]) <= max(0.03 * want[s], 60) for s in size)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mix_edges(spark, edge, empty):
    got = mixing.mixed(edge).collect()
    assert len(got) == edge.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mixed(empty).count() == 0
    again = mixing.resampled(edge)
    assert again.columns == edge.columns
    count = collections.Counter((r.doc_id, r.source) for r in again.collect())
    want = collections.Counter()
    for r in got:
        want[r.doc_id, r.source] += r.copies
    assert count == +want
    assert mixing.resampled(empty).count() == 0


def test_pareto_order_keeps_inclusion_odds(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', 10) as text", "if(id < 2000, 'a', 'b') as source")
    hits = collections.Counter()
    for seed in range(4):
        for r in mixing.mixed(docs, seed=seed).collect():
            hits[r.source] += r.copies
    assert abs(hits["a"] / 4 - 4000 * 5 / 7) < 10 and abs(hits["b"] / 4 - 4000 * 2 / 7) < 10


def test_mix_passes_over_documents_that_do_not_fit(spark):
    """A third of a source's words in one document, over many seeds: the other documents fill the target."""
    rows = [(0, "w " * 4000, "a")] + [(i, "w " * 50, "a") for i in range(1, 161)] + [(1000 + i, "w " * 50, "b") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    for seed in range(12):
        got = mixing.mixed(docs, weights=(3, 17), seed=seed).collect()
        assert all(abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 50 for s in "ab"), seed


# near copies


@pytest.mark.parametrize("most", [1024, 7])
def test_near_copies_by_all_pairs(spark, edge, most):
    rng = np.random.default_rng(6)
    pairs = [(i, t) for i, t in edge.select("doc_id", "text").collect()]
    for c in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        for k in range(6):  # each changed word changes five shingles
            near = list(words)
            for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
                near[at] = f"new{rng.integers(10**6)}"
            pairs.append((100 + 6 * c + k, " ".join(near)))
    grams = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    part = parts_of(len(pairs), [(i, j) for i in range(len(pairs)) for j in range(i) if alike(grams[i], grams[j])])
    low = {}
    for (i, _), p in zip(pairs, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    want = collections.Counter((i, low.get(p)) for (i, _), p in zip(pairs, part))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert collections.Counter(map(tuple, shingles.near_copies(docs, miss=1e-12, most=most).collect())) == want
    assert shingles.near_copies(docs.limit(0)).count() == 0


def test_stage_removes_near_copies_beyond_four_bits(spark, sf):
    import corpus_pipeline

    words = [f"word{i}" for i in range(100)]
    other = words[:30] + ["changed"] + words[31:60] + ["again"] + words[61:]
    texts = [" ".join(words), " ".join(other)]
    assert bin(plain_fingerprint(texts[0]) ^ plain_fingerprint(texts[1])).count("1") > 4
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()] == [0]
