"""Toxicity by class-conditional Kneser-Ney models: two language models, one of toxic and one of ordinary texts.

A word's probability after the word before it is, for each class, its discounted count there
plus its share of a backoff mass, over their sum. Counts are numbers of distinct neighbours on
the left, as the lower orders of Kneser-Ney have them, so what copies repeat counts once. A word alone
is as likely as its beginnings, each after the shorter one, so a form that was never seen is known by
its stem. Backoff masses, the share of each unseen form in them and the discounts come from both
classes' counts together: an expression that is rare in both is about as likely in the one as in the
other, and a class of fewer texts has no rarer words.

A text's evidence are the differences of both log-likelihoods, length-normalised: over the whole text, and over
its best runs of a few words, as one insult in a long text is no less one. A logistic regression of those, fitted
on texts that the counts were not taken from (each half is judged by the counts of the other), makes the score.

The labels are a bounded sample: at most ``SAMPLE`` documents of each class, those whose hash is lowest.
Every text is then scored as a whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint_folder, checkpointed, release, remove

#: Labelled documents of a class that the models are fitted on, at most.
SAMPLE = 6000
#: Distinct neighbours that an expression has at least; rarer ones are left to the backoff.
LEAST = 4
#: Letters of the beginnings that words are known by.
BEGINNINGS = (2, 3, 4, 5, 6, 8)
#: Words of the runs that are judged beside the whole text.
RUNS = (1, 8, 32)
#: Unknown words whose longest known beginning a worker remembers.
REMEMBERED = 1 << 19
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20
# Kana and Han characters are words of their own.
WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W\d_぀-ヿ㐀-䶿一-鿿]+")
BLANK = re.compile(r"\s")


def held_out(id_col: Column) -> Column:
    """Rows whose labels no model sees: a third, by the checksum of the id; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def words(text: str) -> Iterator[list[str]]:
    """The lower-case words of a text, some at a time, so that long texts take no more memory than their numbers."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            blank = BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(toxic, half, text) of the labelled documents that models may learn from, at most ``most`` of each class."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("of")).agg((F.max(label_col) > 0).alias("toxic"))
    known = known.withColumn("hash", F.xxhash64("of", F.lit(11)))
    chosen = [known.where(c).orderBy("hash", "of").limit(most) for c in ("toxic", "not toxic")]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most ids
    texts = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).join(chosen, "of")
    half = F.when(F.pmod(F.xxhash64("of", F.lit(12)), F.lit(2)) == 0, 1).otherwise(2)
    return texts.select("toxic", half.alias("half"), F.coalesce("text", F.lit("")).alias("text"))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (toxic, half, u, v, w) of each text, v empty where it begins; only how many u differ matters, so it is a checksum."""
    for batch in batches:
        for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns)):
            ws = [w for part in words(text) for w in part]
            for at in range(0, len(ws), PIECE):
                part = ["", ""] * (at == 0) + ws[max(at - 2, 0) : at + PIECE]
                seen = list(set(zip(part, part[1:], part[2:])))
                left = np.array([crc32(s[0].encode()) for s in seen], np.uint32).view(np.int32)
                columns = [pa.array(left), *[pa.array([s[i] for s in seen], pa.string()) for i in (1, 2)]]
                flags = [pa.array([toxic] * len(seen), pa.bool_()), pa.array([half] * len(seen), pa.int32())]
                yield pa.RecordBatch.from_arrays([*flags, *columns], names=["toxic", "half", "u", "v", "w"])


def stems(word: str) -> list[str]:
    """The beginnings of a word, shortest first, marked so that none is a word."""
    return [word[:n] + "*" for n in BEGINNINGS if n < len(word)]


def counted(sample: DataFrame, least: int) -> tuple:
    """(pairs, nodes, totals): distinct left neighbours by class, in the first half, the second and both.

    Nodes are words and their beginnings, each with what it goes on from. All are collected: expressions
    of ``least`` neighbours or more in a bounded sample, and a row of totals.
    """
    spark, folder = sample.sparkSession, f"{checkpoint_folder(sample.sparkSession)}/toxicity-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    n = lambda h: F.col(f"n{h}_0") + F.col(f"n{h}_1")
    counts = [(h, c, f"n{h}_{c}") for h in (1, 2, 3) for c in (0, 1)]
    grams = sample.mapInArrow(_trigrams, "toxic boolean, half int, u int, v string, w string").repartition("v", "w")
    grams = grams.groupBy("v", "w", "toxic", "u").agg(F.bit_or("half").alias("m"))
    pairs = stored(grams.groupBy("v", "w").agg(*[F.count_if((F.col("toxic") == bool(c)) & (F.col("m").bitwiseAND(h) > 0)).cast("int").alias(name) for h, c, name in counts]), "pairs")
    words = stored(pairs.groupBy("w").agg(*[F.count_if(F.col(name) > 0).cast("int").alias(name) for _, _, name in counts]), "words")
    ones = [F.count_if(n(h) == k).alias(f"ones{h}_{k}") for h in (1, 2, 3) for k in (1, 2)]
    totals = {"word": words.agg(*ones).first(), "pair": pairs.agg(*ones, *[F.sum(name).alias(f"mass{h}_{c}") for h, c, name in counts]).first()}
    # a word is a node under its longest beginning, that one under the next, and the shortest under the root
    cut = F.array(*[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in BEGINNINGS])
    chain = F.concat(F.array(F.lit("")), F.array_compact(cut), F.array("w"))
    steps = words.select("*", F.posexplode(chain).alias("k", "node")).select("*", F.when(F.col("k") > 0, F.get(chain, F.col("k") - 1)).alias("parent"))
    nodes = stored(steps.groupBy("node", "parent").agg(*[F.sum(name).alias(name) for _, _, name in counts]), "nodes")
    types = [F.count_if(F.col(name) > 0).alias(f"types{h}_{c}") for h, c, name in counts] + [F.count_if(n(h) > 0).alias(f"types{h}") for h in (1, 2, 3)]
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(*types)
    found = pairs.where((n(3) >= least) & (F.col("v") != "")).toPandas(), nodes.where(n(3) >= least).join(below, "node", "left").toPandas(), totals
    remove(spark, folder)
    return found


def discount(totals, half: int) -> float:
    one, two = totals[f"ones{half}_1"], totals[f"ones{half}_2"]
    return one / (one + 2 * two) if one else 0.5


@dataclass
class Model:
    """Both classes' probabilities as arrays over numbered nodes; 0 is the root, where unknown beginnings end."""

    number: dict[str, int]
    alone: np.ndarray  # (2, nodes): probability of a word alone, or of one unseen form of a beginning, by class
    mass: np.ndarray  # (2, nodes): discounted counts after a word
    backoff: np.ndarray  # backoff mass after a word, of both classes together
    pairs: np.ndarray  # sorted: first word * nodes + second
    count: np.ndarray  # (2, pairs): discounted counts

    @classmethod
    def of(cls, pairs, nodes, totals: dict, half: int, least: int) -> Model:
        """From the counts of one half of the sample (1, 2) or of both (3)."""
        numbers = lambda t, name: t[[f"{name}{half}_{c}" for c in (0, 1)]].to_numpy(np.float64).T
        n = numbers(nodes, "n")
        rows = np.flatnonzero((n.sum(0) >= least) | (nodes["node"] == "").to_numpy())
        nodes, n = nodes.iloc[rows], n[:, rows]
        # a beginning comes before what goes on from it, a word of its length and the mark too
        order = np.argsort(2 * nodes["node"].str.len().to_numpy() - nodes["node"].str.endswith("*").to_numpy(), kind="stable")
        nodes, n = nodes.iloc[order], n[:, order]
        number = {w: i for i, w in enumerate(nodes["node"])}
        parent = np.array([number.get(p, 0) for p in nodes["parent"]])
        whole = n[:, 0]
        scale = (whole.sum() / 2 / np.maximum(whole, 1))[:, None]  # both classes brought to the same mass
        d = discount(totals["word"], half)
        mass = scale * np.maximum(n - d * np.nan_to_num(numbers(nodes, "types")), 0)
        types = np.nan_to_num(nodes[f"types{half}"].to_numpy(np.float64))
        log = np.zeros((2, len(nodes)))
        step = np.log(scale * np.maximum(n - d, 0) + d) - np.log(mass + d * np.maximum(types, 1))[:, parent]
        for i in range(1, len(nodes)):
            log[:, i] = log[:, parent[i]] + step[:, i]
        unseen = log + np.log(d) - np.log(mass + d * np.maximum(types, 1))
        stem = types > 0
        alone = np.exp(np.where(stem, unseen, log))

        p = numbers(pairs, "n")
        first, second = (np.array([number.get(w, 0) for w in pairs[c]], np.int64) for c in ("v", "w"))
        rows = np.flatnonzero((p.sum(0) >= least) & (first > 0) & (second > 0))
        first, second = first[rows], second[rows]
        all_pairs = np.array([totals["pair"][f"mass{half}_{c}"] or 0 for c in (0, 1)], np.float64)
        d = discount(totals["pair"], half)
        count = np.maximum(p[:, rows] - d, 0) * (all_pairs.sum() / 2 / np.maximum(all_pairs, 1))[:, None]
        order = np.argsort(first * len(nodes) + second)
        after = np.stack([np.bincount(first, c, len(nodes)) for c in count]) if len(rows) else np.zeros((2, len(nodes)))
        backoff = 1 + d * np.bincount(first, minlength=len(nodes))
        return cls(number, alone, after, backoff, (first * len(nodes) + second)[order], count[:, order])

    def __post_init__(self):
        self.log_ratio = np.log(self.alone[1]) - np.log(self.alone[0])
        self.busy = self.mass.any(0)
        self.known: _Known | None = None

    def numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's words; an unknown word has that of its longest known beginning."""
        if self.known is None:
            self.known = _Known(self.number)
        parts = [np.array(list(map(self.known.__getitem__, ws)), np.int64) for ws in words(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def ratios(self, text: str) -> np.ndarray:
        """How much likelier each word is in toxic than in ordinary texts, as differences of logarithms."""
        w = self.numbered(text)
        out = self.log_ratio[w]
        if len(w) > 1 and len(self.pairs):
            at = np.flatnonzero(self.busy[w[:-1]])
            v, w = w[at], w[at + 1]
            key = v * len(self.busy) + w
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            seen = self.pairs[k] == key
            p = [(np.where(seen, self.count[c][k], 0) + self.backoff[v] * self.alone[c][w]) / (self.mass[c][v] + self.backoff[v]) for c in (0, 1)]
            out[at + 1] = np.log(p[1]) - np.log(p[0])
        return out

    def evidence(self, text: str) -> list[float]:
        """Length-normalised differences: of the whole text, and of its most toxic runs of words."""
        r = self.ratios(text)
        sums = np.concatenate(([0.0], np.cumsum(r)))
        out = [sums[-1] / max(len(r), 8)]
        for n in RUNS:
            best = (sums[n:] - sums[:-n]).max() if len(r) >= n else sums[-1]
            out.append(best / n)
        return [*out, np.log1p(len(r))]


class _Known(dict):
    """Numbers of words, and of so many unknown ones as are remembered."""

    def __init__(self, number: dict[str, int]):
        super().__init__({w: i for w, i in number.items() if not w.endswith("*")})
        self.number, self.own = number, len(self)

    def __missing__(self, word: str) -> int:
        at = next((i for s in reversed(stems(word)) if (i := self.number.get(s)) is not None), 0)
        if len(self) > self.own + REMEMBERED:
            self.__init__(self.number)
        self[word] = at
        return at


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's steps, halved where they overshoot."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack((np.ones((len(x), 1)), (x - mean) / scale))
    pull = np.array([0.0] + [ridge] * x.shape[1])
    loss = lambda b: (weight * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + (pull * b * b).sum() / 2
    b = np.zeros(z.shape[1])
    b[0] = np.log(weight[y == 1].sum() / weight[y == 0].sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        slope = z.T @ (weight * (p - y)) + pull * b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), slope)
        rate, now = 1.0, loss(b)
        while rate > 1e-6 and loss(b - rate * step) > now:
            rate /= 2
        b = b - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    w = b[1:] / scale
    return np.concatenate(([b[0] - w @ mean], w))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE, least: int = LEAST) -> tuple[Model | None, np.ndarray]:
    """The models and the weights of the score. Without labels of both classes there is no model, and every text scores alike."""
    bounded_batches(docs.sparkSession)
    sample = checkpointed(sampled(docs, labels, id_col, text_col, label_col, most))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None, np.array([np.log((sizes.get(True, 0) + 0.5) / (sizes.get(False, 0) + 0.5))])
    counts = counted(sample, least)
    if not (counts[1]["node"] == "").any():  # no words to learn from
        return None, np.array([np.log(sizes[True] / sizes[False])])
    halves = docs.sparkSession.sparkContext.broadcast({h: Model.of(*counts, 3 - h, least) for h in (1, 2)})

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [halves.value[h].evidence(t) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    found = sample.mapInArrow(judged, "toxic boolean, x array<double>").toPandas()  # a few numbers for each document of the sample
    y = found["toxic"].to_numpy(np.float64)
    # the classes weigh as they do among all labels, not as the sample has them
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).agg(F.count_if(F.col(label_col) > 0).alias("t"), F.count("*").alias("n")).first()
    share = (known["t"] / known["n"]) / max(sizes[True], 1), ((known["n"] - known["t"]) / known["n"]) / max(sizes[False], 1)
    weight = np.where(y == 1, share[0], share[1]) * len(y)
    return Model.of(*counts, 3, least), regression(np.array(found["x"].tolist()), y, weight)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, most: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``): one row for each of ``docs``.

    ``score`` is the chance of the label, from 0 to 1; ``predicted`` is 1 from ``threshold`` on. Null and
    empty texts have no words and score by the constant alone. Rows are scored each for itself, so rows of
    one id have one row each; of labels of one id the highest counts; null ids, null labels and held-out
    labels are not learned from. Without labels of both classes all texts score alike. An empty table
    gives an empty result. Extra columns, and all but id, text and label, are not read.
    """
    model, weights = fitted(docs, labels, id_col, text_col, label_col, most, least)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))  # bounded by the sample

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, b = shared.value
        for batch in batches:
            x = np.array([model.evidence(t.as_py()) if model else [] for t in batch.column(1)]).reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
