"""The engine: index a source, search it, read, relate, check and watch it."""

from __future__ import annotations

import base64
import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, text
from .operators import chunking, graph, lexical, policy, reconcile, vectors
from .sources import filesystem, git
from .sources.store import Store

HISTORY = ("message", "revision_id", "paths", "host")
FIELDS, EXTRA = ("path", "heading", "symbol", "text"), ()
PARSER = "1"
#: Buckets of paths: what a build writes again is the buckets of the files that changed.
BUCKETS = 64
BUCKETED = ("files", "chunks", "symbols", "links", "refs", "postings", "chunk_vec")
PAGE, PAGE_MOST, BUDGET, TTL_MS = 5, 20, 1200, 3_600_000


@dataclass
class Config:
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    max_file_bytes: int = 1 << 20
    rrf_k: int = vectors.RRF_K

    @classmethod
    def load(cls, value: str | dict, *over: dict) -> Config:
        """A closed schema: unknown keys are refused. Later layers replace single values and add to lists."""
        merged: dict = {}
        for layer in (json.loads(value) if isinstance(value, str) else value, *over):
            if unknown := set(layer) - set(cls.__dataclass_fields__):
                raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
            for k, v in layer.items():
                merged[k] = merged.get(k, []) + v if isinstance(v, list) else v
        return cls(**merged)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True).encode()).hexdigest()


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Engine:
    """One corpus, from a directory to a store; both are any path that Spark reads."""

    def __init__(self, spark: SparkSession, source: str, store: str, config: Config | None = None):
        self.spark, self.source, self.store = spark, source.rstrip("/"), Store(spark, store)
        self.config = config or Config()
        self.scope = hashlib.sha256(f"directory|{self.source}".encode()).hexdigest()

    def rules(self) -> list[policy.Rule]:
        """Defaults, settings, and the ignore files of the source."""
        return policy.rules(self.config.includes, self.config.excludes, filesystem.ignore_files(self.spark, self.source))

    # building

    def index(self, embeddings: DataFrame | None = None, history: DataFrame | None = None) -> dict:
        """Build the next generation; nothing changes if files, settings, vectors and history are the served ones.

        ``embeddings`` (input_hash, vector) gives vectors of chunk texts by their hash, beside those
        of the served generation; chunks without one are pending. ``history`` is a table of commits;
        without one the served one stays. The record that is returned says what came of the files: ``outcome``
        counts those new, changed, removed and unchanged.
        """
        intake = filesystem.intake(self.spark, self.source, self.rules(), self.config.max_file_bytes)
        files = filesystem.classified(intake).withColumn("parser_version", F.lit(PARSER)).withColumn("bucket", bucket_of(F.col("path")))
        self._folder = uuid.uuid4().hex
        try:
            files = self._staged("files", files)
            manifest = reconcile.manifest_hash(files).first()["manifest_hash"]
            record = {"manifest_hash": manifest, "config_fingerprint": self.config.fingerprint(), "parser": PARSER, "scope": self.scope}
            served = self.store.current() or {}
            record["vectors"] = served.get("vectors") if embeddings is None else self._sign(embeddings.select("input_hash", "vector"))
            record["history_head"] = served.get("history_head") if history is None else self._sign(history)
            if served and all(served.get(k) == record[k] for k in ("manifest_hash", "config_fingerprint", "vectors", "history_head")):
                self.store.fail(None)
                return served
            tables, kept, numbers = self._changes(files, served, embeddings)
            if history is not None:
                items = self._items(history)
                posted = lexical.positional(items, HISTORY, key="item_id").repartitionByRange("term").sortWithinPartitions("term")
                tables |= {"history": history, "history_postings": posted}
                found = lexical.corpus_stats(items, HISTORY).first()
                numbers["history_stats"] = [found["n"], found["mean_length"] or 0.0]
            else:
                kept |= {n: served["parts"][n] for n in ("history", "history_postings") if n in served.get("parts", {})}
                numbers["history_stats"] = served.get("history_stats")
            published = self.store.publish(tables, record | numbers, kept)
            self.store.fail(None)
            return published
        except Exception as error:
            self.store.fail(str(error)[:500])
            raise
        finally:
            self.store.unstage(self._folder)

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        return self.store.staged(self._folder, name, rows)

    def _changes(self, files: DataFrame, served: dict, embeddings: DataFrame | None) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]], dict]:
        """What a build writes, the buckets it takes over, and its numbers.

        Files are told apart by path, content and parser. Only new and changed ones are cut; the rest of their
        bucket is copied from the served generation, and buckets without a change stay as they are. References are
        looked up anew where a file changed that they, or an import of theirs, might mean.
        """
        # another parser or scope makes other ids, and a record without parts has nothing to take over
        base = served if served.get("parts") and served.get("parser") == PARSER and served.get("scope") == self.scope else {}
        none = self.spark.createDataFrame([], "path string, content_hash string, parser_version string, language string, role string")
        before = self.store.table("files", base).select(*none.columns) if base else none
        # what a file's chunks show of it besides its content is its role and language
        known = lambda df: df.select("path", F.concat_ws("|", "content_hash", "language", "role").alias("content_hash"), "parser_version")
        states = self._staged("states", reconcile.reconciled(known(files), known(before)).withColumn("bucket", bucket_of(F.col("path"))))
        outcome = {s: 0 for s in ("new", "changed", "removed", "unchanged")} | {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        changed = states.where("state != 'unchanged'")
        buckets = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most BUCKETS
        kept = {n: {b: g for b, g in base["parts"][n].items() if int(b) not in buckets} for n in BUCKETED if n in base.get("schemas", {})}

        paths = changed.select("path")
        fresh = files.join(paths, "path", "left_semi")

        def carried(name: str, made: DataFrame) -> DataFrame:
            """New rows of a table, and in their buckets the served ones of files that did not change."""
            made = made.withColumn("bucket", bucket_of(F.col("path")))
            if name not in kept:
                return made
            return self.store.table(name, base, buckets).join(paths, "path", "left_anti").unionByName(made)

        made = self._parsed(fresh)
        chunks, symbols, links = (self._staged(n, carried(n, made[n])) for n in ("chunks", "symbols", "links"))
        whole = lambda name, rows: rows.unionByName(self.store.table(name, base | {"parts": kept})) if name in kept else rows
        tables = {
            "files": files.where(F.col("bucket").isin(buckets)).drop("text"),
            # files of one path range each, so that a page reads the row groups of its paths only
            "chunks": chunks.repartitionByRange("bucket", "path").sortWithinPartitions("bucket", "path", "ord"),
            "symbols": symbols,
            "links": links,
        }
        posted = lexical.positional(chunks, FIELDS).join(chunks.select("chunk_id", "bucket"), "chunk_id")
        tables["postings"] = posted.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")

        # references of changed files, and of files that import from them
        all_links, all_symbols = whole("links", links), whole("symbols", symbols)
        importers = graph.importers(all_links.where("kind = 'import'"), paths)
        touched = sorted({r.bucket for r in importers.select(bucket_of(F.col("path")).alias("bucket")).distinct().collect()} | set(buckets))
        kept["refs"] = {b: g for b, g in base.get("parts", {}).get("refs", {}).items() if int(b) not in touched}
        tables["refs"] = self._resolved(all_links.where(F.col("bucket").isin(touched)), all_symbols, files).withColumn("bucket", bucket_of(F.col("path")))

        # what ranking needs of the whole corpus is kept in the record, so that a search scans no texts for it
        counted = lexical.corpus_stats(chunks, FIELDS, EXTRA, by="bucket").collect()  # at most BUCKETS
        stats = {b: v for b, v in base.get("stats", {}).items() if int(b) not in buckets} | {str(r.bucket): [r.n, r.words] for r in counted}
        n, words = (sum(v[i] for v in stats.values()) for i in (0, 1))
        numbers = {"outcome": outcome, "stats": stats, "chunks": n, "mean_length": words / n if n else 0.0}

        have = "chunk_vec" in base.get("schemas", {})
        if have or embeddings is not None:
            known_vectors = self.store.table("chunk_vec", base).select("input_hash", "vector").dropDuplicates(["input_hash"]) if have else None
            rows, vectors = chunks, known_vectors
            if embeddings is not None:  # new vectors may be of any chunk
                rows, vectors = whole("chunks", chunks), embeddings.select("input_hash", "vector")
                vectors = vectors if known_vectors is None else vectors.unionByName(known_vectors.join(embeddings, "input_hash", "left_anti"))
                kept["chunk_vec"] = {}
            hashed = rows.select("chunk_id", "bucket", F.sha2("text", 256).alias("input_hash"))
            tables["chunk_vec"] = hashed.join(vectors, "input_hash").select("chunk_id", "input_hash", F.size("vector").alias("dimension"), "vector", "bucket")
        if not buckets and base:  # vectors or history alone are new
            tables = {n: df for n, df in tables.items() if n == "chunk_vec" and embeddings is not None}
            kept |= {n: base["parts"][n] for n in base.get("parts", {}) if n not in tables and n in BUCKETED}
        return tables, kept, numbers

    def _items(self, history: DataFrame) -> DataFrame:
        """Commits as they are searched: what a table of them lacks is empty."""
        empty = {"message": "string", "revision_id": "string", "author": "string", "committed_at_ms": "bigint", "affected_paths": "array<string>", "pr_hint": "array<int>", "host": "string"}
        for name, kind in empty.items():
            history = history if name in history.columns else history.withColumn(name, F.lit(None).cast(kind))
        own = F.concat(F.lit("hist-"), F.sha2(F.concat(F.lit(self.scope + "\n"), F.coalesce("revision_id", F.lit(""))), 256))
        history = history if "item_id" in history.columns else history.withColumn("item_id", own)
        return history.select("item_id", *empty, F.array_join(F.coalesce("affected_paths", F.array()), " ").alias("paths"))

    @staticmethod
    def _sign(rows: DataFrame) -> str:
        """A fingerprint of a table's rows in any order, repeats counted."""
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")
        found = rows.agg(F.count("*").alias("n"), F.sum(digest).alias("s")).first()
        return f"{found['n']}:{found['s']}"

    def _parsed(self, files: DataFrame) -> dict[str, DataFrame]:
        """Chunks, symbols, and references as they are written in ``files``."""
        scope = F.lit(self.scope)
        raw = chunking.chunked(files)
        # ids come from the raw text, what is stored is redacted
        key = lambda address, body: F.concat(F.lit("chunk-"), F.sha2(F.concat_ws("\n", scope, F.lit(PARSER), F.col("path"), address, F.sha2(body, 256)), 256))
        held = self._staged("cut", raw.withColumn("chunk_id", key(F.col("address"), F.col("text"))))
        parents = held.where("parent is null").select("path", F.col("address").alias("parent"), F.col("chunk_id").alias("parent_chunk_id"))
        safe = text.redacted(F.col("text"))
        chunks = held.join(parents, ["path", "parent"], "left").join(files.select("path", "role"), "path")
        chunks = chunks.select(
            "chunk_id", "parent_chunk_id", "path", "role", "heading", "symbol", "kind", "line_start", "line_end",
            safe.alias("text"), F.sha2(safe, 256).alias("text_hash"), "ord",
        )
        found = chunking.symbols(files)
        sid = F.concat(F.lit("sym-"), F.sha2(F.concat_ws("\n", scope, "path", "kind", "name", "line_start"), 256))
        found = found.withColumn("symbol_id", sid)
        placed = graph.covering_chunk(found.select("path", F.col("symbol_id").alias("ref_id"), F.col("line_start").alias("line")).distinct(), held)
        symbols = found.join(placed.select(F.col("ref_id").alias("symbol_id"), "chunk_id"), "symbol_id", "left").dropDuplicates(["symbol_id"])
        rid = F.concat(F.lit("ref-"), F.sha2(F.concat_ws("\n", scope, "path", "kind", "name", "line", "ord"), 256))
        links = graph.covering_chunk(chunking.references(files).withColumn("ref_id", rid), held)
        return {"chunks": chunks, "symbols": symbols, "links": links}

    @staticmethod
    def _resolved(links: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
        """References with their target: a symbol of the file, else what an import of that name means."""
        imported = graph.resolved_modules(links.where("kind = 'import'"), files)
        named = symbols.select(F.col("path").alias("target"), "name", F.col("symbol_id").alias("imported"), F.col("ord").alias("s_ord"))
        hit = imported.join(named, ["target", "name"]).groupBy("path", "name").agg(F.min_by("imported", F.struct("ord", "s_ord")).alias("imported"))
        local = graph.local_symbols(links.where("kind != 'import'"), symbols).select("ref_id", F.col("symbol_id").alias("local"))
        out = links.join(local, "ref_id", "left").join(hit, ["path", "name"], "left")
        certain = (F.col("kind") == "import") & F.col("imported").isNotNull()
        return out.select("ref_id", "path", "name", "kind", "line", "chunk_id", F.coalesce("local", "imported").alias("target_symbol_id"), F.when(certain, "certain").otherwise("uncertain").alias("confidence"))

    # queries

    def search(self, query: str, path: str | None = None, role: str | None = None, size: int = PAGE, budget: int = BUDGET, cursor: str | None = None, mode: str = "lexical", vector: list[float] | None = None) -> tuple[DataFrame, dict]:
        """A page of hits and its envelope: the mode that ran, why it fell back, and the next cursor."""
        terms, size = lexical.terms_of(query), min(size, PAGE_MOST)
        offset = self._offset(cursor, query, path, role, mode)
        ran = mode if mode == "lexical" or (vector is not None and self.store.has("chunk_vec")) else "lexical"
        chunks = self.store.table("chunks")
        named = chunks.select("chunk_id", "path", "role", "heading", "line_start")
        if path:
            named = named.where(F.col("path").rlike(text.glob_regex(path)))
        if role:
            named = named.where(F.col("role") == role)
        order = [F.round("score", 9), F.col("path"), F.col("line_start"), F.col("chunk_id")]
        lists = []
        if ran != "vectors-only":
            hits = self._lexical(terms, named)
            lists.append(hits)
        if ran != "lexical":
            lists.append(self._nearest(vector, named))
        if ran == "lexical":
            ranked = lists[0]
        else:
            numbered = [x.withColumn("rank", F.row_number().over(lexical.W.orderBy(*order))) for x in lists]
            fused = vectors.fused(numbered, "chunk_id", self.config.rrf_k).select("chunk_id", (-F.col("score")).alias("score"))
            ranked = fused.join(named, "chunk_id").withColumn("why", F.lit("fused ranks" if ran == "hybrid" else "vector match"))
        ranked = lexical.per_file(ranked, order)
        page = lexical.page(ranked, order, offset, size + 1)
        page = page.persist()
        paths = [r.path for r in page.select("path").distinct().collect()]  # a page's, at most 21
        bodies = chunks.where(F.col("path").isin(paths)).select("chunk_id", "line_end", text.excerpt(F.col("text"), terms or [""]).alias("excerpt"), text.estimated_tokens(F.col("text")).alias("tokens"))
        page = bodies.join(F.broadcast(page.select("chunk_id", "path", "role", "heading", "line_start", "rank", "score", "why")), "chunk_id")  # at most a page
        kept = lexical.within_budget(page.withColumn("rank", F.col("rank") - offset), F.col("tokens"), budget)
        kept = kept.where(F.col("rank") <= size).withColumn("rank", F.col("rank") + offset).drop("spent").orderBy("rank").persist()
        n, more = kept.count(), page.count()
        envelope = {"mode": ran, "degraded": ran != mode, "generation_id": self.store.current()["generation_id"], "hits": n}
        envelope["next_cursor"] = self._cursor(offset + n, query, path, role, mode) if more > n else None
        return kept, envelope

    def _matched(self, terms: list[str], table: str, chunks: int, mean_length: float, key: str) -> DataFrame | None:
        """(key, score) of what holds every term in some field, from a table of postings; none without terms, or with one that has no token."""
        cut = self.spark.range(1).select(*[text.tokens(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first() if terms else []
        if not terms or any(not row for row in cut):
            return None
        # a term that is cut into several tokens is a phrase, with a frequency of its own
        phrases, tokens = [list(row) for row in cut], sorted({t for row in cut for t in row})
        found = lexical.phrase_postings(self.store.table(table).where(F.col("term").isin(tokens)), phrases, key)
        stats = self.spark.range(1).select(F.lit(chunks).alias("n"), F.lit(mean_length).alias("mean_length"))
        return lexical.bm25(found, stats, [" ".join(p) for p in phrases], key)

    def _lexical(self, terms: list[str], named: DataFrame) -> DataFrame:
        single, record = [t for t in terms if t], self.store.current()
        scored = self._matched(single, "postings", record["chunks"], record["mean_length"], "chunk_id")
        if scored is None:
            return named.limit(0).withColumn("score", F.lit(0.0)).withColumn("why", F.lit(""))
        hits = lexical.top(scored.join(named, "chunk_id"), lexical.CANDIDATES, F.round("score", 9), "path", "line_start")
        p, h = lexical.path_boost(F.col("path"), single), lexical.heading_boost(F.col("heading"), single)
        r = lexical.role_boost(F.col("role"), classify.is_fixture(F.col("path")), single)
        return hits.withColumn("why", lexical.explained(p, h, r)).withColumn("score", F.col("score") + p + h + r)

    def _nearest(self, vector: list[float], named: DataFrame) -> DataFrame:
        one = self.spark.createDataFrame([(vector,)], "vector array<float>")
        scored = vectors.scored(self.store.table("chunk_vec").select("chunk_id", "vector"), one, "vector").join(named, "chunk_id")
        best = vectors.top(scored, vectors.VECTOR_CAP, "chunk_id")
        return best.withColumn("score", -F.col("cosine")).drop("cosine").withColumn("why", F.lit("vector match"))

    def _key(self, *parts) -> str:
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]

    def _cursor(self, offset: int, query: str, path, role, mode) -> str:
        value = {"v": 1, "g": self.store.current()["generation_id"], "q": self._key(query), "f": self._key(path, role, mode), "o": offset, "t": int(time.time() * 1000)}
        return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")

    def _offset(self, cursor: str | None, query: str, path, role, mode) -> int:
        if cursor is None:
            return 0
        value = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        same = value["v"] == 1 and value["q"] == self._key(query) and value["f"] == self._key(path, role, mode)
        if not same or value["g"] != self.store.current()["generation_id"] or time.time() * 1000 - value["t"] > TTL_MS:
            raise ValueError("the cursor does not belong to this query, filter or generation, or has expired")
        return value["o"]

    def read(self, chunk_id: str, budget: int = BUDGET) -> dict:
        """A chunk's text with the state of its source: fresh, stale or gone."""
        chunk = self.store.table("chunks").where(F.col("chunk_id") == chunk_id).first()
        if chunk is None:
            raise LookupError(chunk_id)
        path = filesystem.contained(chunk.path)
        seen = filesystem.content_hash(self.spark, self.source, path)
        was = self.store.table("files").where(F.col("path") == chunk.path).first()
        state = "gone" if seen is None else "fresh" if seen == was.content_hash else "stale"
        lines, kept, spent = chunk.text.split("\n"), [], 0
        for line in lines:
            spent += len(line) + 1
            if kept and spent > 4 * budget:
                break
            kept.append(line[: 4 * budget])
        return {"chunk_id": chunk_id, "path": chunk.path, "lines": (chunk.line_start, chunk.line_end), "text": "\n".join(kept), "truncated": len(kept) < len(lines), "state": state}

    def related(self, chunk_id: str, limit: int = 10, budget: int = BUDGET) -> DataFrame:
        """Neighbours of a chunk in order of relation, as many as the token budget allows; the first always.

        What is sent of the source, and of each neighbour, is its title, its path and an excerpt, and 16 tokens more.
        """
        chunks = self.store.table("chunks")
        edges = graph.edges_out(self.store.table("refs"), self.store.table("symbols"))
        found = graph.related(chunk_id, edges, chunks.select("chunk_id", "parent_chunk_id"), chunks, min(limit, PAGE_MOST))
        title = lambda df: F.when(df["heading"] == "", df["path"]).otherwise(F.coalesce(df["heading"], df["path"]))
        sent = lambda df: text.estimated_tokens(title(df)) + text.estimated_tokens(df["path"]) + 16
        source = chunks.where(F.col("chunk_id") == chunk_id).select(sent(chunks).alias("t")).first()
        bodies = chunks.select("chunk_id", "line_end", title(chunks).alias("title"), text.bounded(F.col("text")).alias("excerpt"), (sent(chunks) + text.estimated_tokens(text.bounded(F.col("text")))).alias("tokens"))
        ranked = found.withColumn("rank", F.row_number().over(lexical.W.orderBy("kind_rank", "path", "line_start", "chunk_id")))  # a page
        shown = bodies.join(F.broadcast(ranked), "chunk_id")
        kept = lexical.within_budget(shown, F.col("tokens"), budget - (source.t if source else 0))
        return kept.select(*found.columns, "line_end", "title", "excerpt", "tokens", "rank").orderBy("rank")

    def history(self, query: str, path: str | None = None, size: int = PAGE, cursor: str | None = None) -> tuple[DataFrame, dict]:
        """A page of commits that hold every term in message, revision, paths or host's words, and its envelope.

        ``path`` is a glob that one of a commit's paths matches. A served generation without history has no hits.
        """
        record = self.store.current()
        if record is None:
            raise LookupError("nothing is published")
        offset, size = self._offset(cursor, query, path, None, "history"), min(size, PAGE_MOST)
        n, mean_length = record.get("history_stats") or (0, 0.0)
        envelope = {"mode": "history", "generation_id": record["generation_id"], "lane": {"enabled": self.store.has("history"), "items": n}}
        scored = self._matched(lexical.terms_of(query), "history_postings", n, mean_length, "item_id") if self.store.has("history_postings") else None
        if scored is None:
            none = "item_id string, revision_id string, message string, author string, committed_at_ms long, affected_paths array<string>, pr_hint array<int>, rank int, score double"
            return self.spark.createDataFrame([], none), envelope | {"hits": 0, "next_cursor": None}
        items = self._items(self.store.table("history"))
        if path:
            items = items.where(git.touches(F.coalesce("affected_paths", F.array()), path))
            scored = scored.join(items.select("item_id"), "item_id", "left_semi")
        order = [F.round("score", 9), F.col("item_id")]
        page = lexical.page(lexical.top(scored, lexical.CANDIDATES, *order), order, offset, size + 1)
        shown = items.join(F.broadcast(page), "item_id")  # a page
        shown = shown.select("item_id", "revision_id", text.bounded(F.col("message")).alias("message"), "author", "committed_at_ms", "affected_paths", "pr_hint", "rank", "score").persist()
        more = shown.count() > size
        shown = shown.where(F.col("rank") <= offset + size).orderBy("rank")
        hits = shown.count()
        return shown, envelope | {"hits": hits, "next_cursor": self._cursor(offset + hits, query, path, None, "history") if more else None}

    def explain(self, path: str) -> dict:
        """Whether a path is taken in, and the rule that says so."""
        rules = self.rules()
        found = self.spark.range(1).select(policy.decision(F.lit(path), rules).alias("d")).first().d
        return {"path": path, "included": found.included, "rule": None if found.rule is None else rules[found.rule]}

    def status(self) -> dict:
        """The served generation against the source now."""
        served = self.store.current()
        files = filesystem.classified(filesystem.intake(self.spark, self.source, self.rules(), self.config.max_file_bytes))
        manifest = reconcile.manifest_hash(files).first()["manifest_hash"]
        if served is None:
            return {"state": "unknown", "reasons": [], "last_error": self.store.last_error()}
        differ = {"manifest": served["manifest_hash"] != manifest, "config": served["config_fingerprint"] != self.config.fingerprint()}
        reasons = [k for k, v in differ.items() if v]
        return {"state": "stale" if reasons else "fresh", "reasons": reasons, "generation_id": served["generation_id"], "last_error": self.store.last_error()}

    def check(self, require_vectors: bool = False) -> str:
        """ok, missing, stale or coverage-not-met."""
        found = self.status()
        if found["state"] != "fresh":
            return "missing" if found["state"] == "unknown" else "stale"
        if require_vectors:
            none = self.spark.createDataFrame([], "chunk_id string")
            have = self.store.table("chunk_vec").select("chunk_id") if self.store.has("chunk_vec") else none
            if reconcile.coverage(self.store.table("chunks"), have, F.lit(True)).first().level != "complete":
                return "coverage-not-met"
        return "ok"

    def watch(self, changes: DataFrame, checkpoint: str, every: str | None = None):
        """Index after each batch of a stream of changes; a batch that changes nothing publishes nothing."""
        from .streaming import events

        return events.watch(changes, lambda batch, epoch: self.index() if not batch.isEmpty() else None, checkpoint, every)

    def purge(self) -> None:
        self.store.purge()
