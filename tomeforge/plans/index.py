"""Index-build queries: policy, classification, identity, reconciliation, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import graph, policy, reconcile
from ..session import table
from ..sources import corpus

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Paths that differ by document number, to meet every rule of path policy and classification.
SHAPES = (
    "src/a%d.ts", "node_modules/m/i%d.js", "docs/.env", "app/.env.example", "keep/build/o%d.txt", "docs/plans/p%d.md", "docs/adr/d%d.md",
    "web/a%d.min.js", "logs/x%d.txt", "conf/c%d.yaml", "AGENTS.md", "archive/old%d.rst", "x/decisions.txt/y%d", "testdata/plans/t%d.md", "k/id_rsa", "noext%d",
)
PATH_SQL = "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {f'printf({chr(39)}{s}{chr(39)}, doc_id)' if '%d' in s else chr(39) + s + chr(39)}" for i, s in enumerate(SHAPES)) + " END"


def shaped(spark, sf_dir):
    which = F.col("doc_id") % len(SHAPES)
    path = F.coalesce(*[F.when(which == i, F.format_string(s, "doc_id") if "%d" in s else F.lit(s)) for i, s in enumerate(SHAPES)])
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


RULES = policy.rules(includes=["keep/**", "**"], excludes=["keep/", "*.rst"])


@register(f"""WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents)
SELECT doc_id, path, NOT (regexp_matches(path, '(^|/)(node_modules|build|logs|keep)/') OR regexp_matches(path, '[.]min[.]js$|[.]rst$') OR regexp_matches(path, '(^|/)([.]env|id_rsa)$')) OR path LIKE 'keepnot%' AS included FROM p""")
def policy_glob_last_match(spark, sf_dir):
    """keep/ is left out as a directory, so including what is in it has no effect."""
    return shaped(spark, sf_dir).select("doc_id", "path", policy.decision(F.col("path"), RULES)["included"].alias("included"))


EXT = "lower(CASE WHEN regexp_matches(path, '[^/][.][^./]*$') THEN regexp_extract(path, '[.]([^./]*)$', 1) ELSE '' END)"


@register(f"""WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents)
SELECT doc_id, CASE {EXT} WHEN 'md' THEN 'markdown' WHEN 'rst' THEN 'restructuredtext' WHEN 'ts' THEN 'ts' WHEN 'js' THEN 'js' WHEN 'yaml' THEN 'yaml' ELSE 'text' END AS language FROM p""")
def language_detect(spark, sf_dir):
    return shaped(spark, sf_dir).select("doc_id", classify.language(F.col("path")).alias("language"))


@register(f"""WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents), r AS (
SELECT CASE WHEN path = 'AGENTS.md' THEN 'instruction' WHEN {EXT} IN ('ts', 'js') THEN 'code' WHEN {EXT} = 'yaml' THEN 'config'
  WHEN contains('/' || path || '/', '/plans/') THEN 'plan' WHEN contains('/' || path || '/', '/adr/') THEN 'decision' WHEN path LIKE 'archive/%' THEN 'historical' ELSE 'current-doc' END AS role, path LIKE 'testdata/%' AS fixture FROM p)
SELECT role, fixture, count(*) AS files FROM r GROUP BY ALL""")
def classify_roles(spark, sf_dir):
    rows = shaped(spark, sf_dir).select(classify.inferred(F.col("path"))["role"].alias("role"), classify.is_fixture(F.col("path")).alias("fixture"))
    return rows.groupBy("role", "fixture").agg(F.count("*").alias("files"))


@register("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'plan' WHEN doc_id % 3 = 1 THEN NULL ELSE NULL END AS role, CASE WHEN doc_id % 3 = 0 THEN 'accepted' ELSE NULL END AS status FROM documents""")
def front_matter(spark, sf_dir):
    """A closed block tells role and status; an open one, or unknown values, tell nothing."""
    head = F.when(F.col("doc_id") % 3 == 0, '---\nrole: decision\nrole: "plan"\nstatus: accepted\n---\n').when(F.col("doc_id") % 3 == 1, "---\nrole: plan\n").otherwise("---\nrole: king\n---\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", classify.front_matter(F.concat(head, F.regexp_replace("text", "---", ""))).alias("f"))
    return docs.select("doc_id", "f.role", "f.status")


@register("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'k [REDACTED]!' WHEN 1 THEN 'x [REDACTED] y [REDACTED]' WHEN 2 THEN 'a [REDACTED] z' ELSE 'plain ' || doc_id END AS safe, doc_id % 4 < 3 AS secret FROM documents""")
def secret_redact(spark, sf_dir):
    number = F.lpad(F.upper(F.hex("doc_id")), 16, "0")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("k AK"), F.lit("IA"), number, F.lit("!")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x gh"), F.lit("p_"), F.lpad(number, 36, "a"), F.lit(" y xox"), F.lit("b-1234567890")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("a -----BEGIN RSA PRIVATE "), F.lit("KEY-----\n"), number, F.lit("\n-----END RSA PRIVATE KEY----- z")))
        .otherwise(F.concat(F.lit("plain "), F.col("doc_id").cast("string")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(raw).alias("safe"), text.has_secret(raw).alias("secret"))


@register("""SELECT reason, count(*) AS files FROM (SELECT CASE WHEN octet_length(encode(text)) > 6000 THEN 'file_too_large' WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'secret_content' ELSE 'accepted' END AS reason FROM documents) GROUP BY reason""")
def skip_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    reason = policy.skip_reason(F.octet_length("text"), F.is_valid_utf8("text"), text.has_secret(F.col("text")), 6000)
    return docs.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("files"))


# identity

HASHED = "SELECT path, sha256(text) AS content_hash, octet_length(encode(text)) AS size, doc_id FROM files"


def hashed(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return files.select("doc_id", "path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").alias("size"), F.lit("p1").alias("parser_version"))


@register(f"WITH {corpus.SQL} SELECT sha256(string_agg(path || chr(0) || content_hash || chr(0) || size || chr(0), '' ORDER BY path)) AS manifest_hash, count(*) AS files FROM ({HASHED})")
def manifest_hash(spark, sf_dir):
    return reconcile.manifest_hash(hashed(spark, sf_dir))


@register(f"WITH {corpus.SQL} SELECT 'chunk-' || sha256('repo|worktree' || chr(10) || 'v1' || chr(10) || path || chr(10) || line || chr(10) || sha256(body)) AS chunk_id, path, line FROM chunks")
def chunk_ids(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir).select("path", "line", F.col("line").cast("string").alias("address"), F.col("body").alias("text"))
    return reconcile.chunk_ids(rows, "repo|worktree", "v1").select("chunk_id", "path", "line")


@register("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS encoded FROM documents")
def estimate_and_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.base64url(F.col("text")).alias("encoded"))


# reconciliation

BEFORE = "SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash, doc_id FROM hashed WHERE doc_id % 10 <> 0 UNION ALL SELECT 'gone/' || doc_id, 'x', doc_id FROM hashed WHERE doc_id % 50 = 0"


def snapshots(spark, sf_dir):
    now = hashed(spark, sf_dir)
    kept = now.where("doc_id % 10 != 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    gone = now.where("doc_id % 50 = 0").withColumns({"path": F.concat(F.lit("gone/"), F.col("doc_id")), "content_hash": F.lit("x")})
    return now, kept.unionByName(gone)


@register(f"WITH {corpus.SQL}, hashed AS ({HASHED}), was AS ({BEFORE}) SELECT coalesce(h.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'new' WHEN h.path IS NULL THEN 'removed' WHEN h.content_hash = w.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM hashed h FULL JOIN was w ON h.path = w.path")
def reconcile_full_outer(spark, sf_dir):
    return reconcile.reconciled(*snapshots(spark, sf_dir))


@register(f"WITH {corpus.SQL}, hashed AS ({HASHED}), was AS ({BEFORE}), s AS (SELECT CASE WHEN w.path IS NULL THEN 'new' WHEN h.path IS NULL THEN 'removed' WHEN h.content_hash = w.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM hashed h FULL JOIN was w ON h.path = w.path) SELECT count(*) FILTER (state = 'new') AS added, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'changed') AS reparsed, count(*) FILTER (state = 'unchanged') AS reused FROM s")
def index_outcome(spark, sf_dir):
    state = F.col("state")
    counts = [F.count_if(state == s).alias(n) for s, n in (("new", "added"), ("removed", "removed"), ("changed", "reparsed"), ("unchanged", "reused"))]
    return reconcile.reconciled(*snapshots(spark, sf_dir)).agg(*counts)


@register(f"WITH {corpus.SQL}, hashed AS ({HASHED}), was AS ({BEFORE}) SELECT coalesce(h.path, w.path) AS path FROM hashed h FULL JOIN was w ON h.path = w.path WHERE h.content_hash IS DISTINCT FROM w.content_hash")
def changed_paths(spark, sf_dir):
    return reconcile.changed_paths(*snapshots(spark, sf_dir))


@register(f"WITH {corpus.SQL}, hashed AS ({HASHED}), was AS ({BEFORE}) SELECT path FROM was EXCEPT SELECT path FROM hashed")
def removed_files(spark, sf_dir):
    now, was = snapshots(spark, sf_dir)
    return was.select("path").subtract(now.select("path"))


@register("SELECT d.source AS path FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL GROUP BY 1")
def pending_vectors_anti(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"))
    return reconcile.pending(chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@register("SELECT *, greatest(eligible - vectors, 0) AS pending, CASE WHEN vectors = 0 THEN 'none' WHEN eligible > vectors THEN 'partial' ELSE 'complete' END AS level FROM (SELECT count(*) AS total, count(*) FILTER (lang <> 'es') AS eligible, count(vec_id) AS vectors FROM documents LEFT JOIN embeddings ON doc_id = vec_id)")
def coverage_levels(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    return reconcile.coverage(chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), F.col("lang") != "es")


@register("SELECT user_id % 5 AS repo_id, event_type AS worktree_id, event_id AS generation_id, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id DESC) AS age FROM events) WHERE age <= 2")
def retention_latest2(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("repo_id"), F.col("event_type").alias("worktree_id"), F.col("event_id").alias("generation_id"))
    return reconcile.latest(rows)


@register("SELECT o_orderkey AS input_hash FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def gc_anti_grace(spark, sf_dir):
    """Orders as cache entries; large lines refer to them."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input_hash"), F.lit("f").alias("fingerprint"), F.col("o_orderdate").alias("created"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("input_hash"), F.lit("f").alias("fingerprint"))
    return reconcile.unreferenced(cache, used, F.lit("1996-01-01").cast("timestamp")).select("input_hash")


@register("SELECT p_partkey AS key FROM part ORDER BY p_size DESC, p_partkey LIMIT 100")
def cache_bound(spark, sf_dir):
    cache = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("mtime"))
    return reconcile.newest_first(cache, 100).select("key")


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unknown' WHEN doc_id % 4 = 0 THEN 'fresh' ELSE 'stale' END AS state, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'mode,config' WHEN 2 THEN 'config' ELSE 'manifest' END AS reasons FROM documents")
def freshness_verdict(spark, sf_dir):
    k = F.col("doc_id") % 4
    v = reconcile.freshness(F.lit("worktree"), F.when(k == 1, "committed").otherwise("worktree"), F.lit("m"), F.when(k != 3, "m"), F.lit("c"), F.when(k.isin(1, 2), "d").otherwise("c"))
    return table(spark, sf_dir, "documents").select("doc_id", v["state"].alias("state"), F.array_join(v["reasons"], ",").alias("reasons"))


@register("WITH c AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, sum(length(text)) OVER (ORDER BY doc_id) AS spent FROM documents) SELECT doc_id AS chunk_id, CAST((rn - 1) // 32 AS BIGINT) AS batch, spent <= 500000 AND (rn - 1) // 32 < 10 AS sent FROM c WHERE rn <= 320")
def embed_batches(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    return reconcile.embed_batches(chunks, "doc_id", 32, 10, 500_000).select("chunk_id", "batch", "sent")


# graph

WINDOWS = "SELECT path, (line - 1) // 3 AS ord, (line - 1) // 3 * 3 + 1 AS line_start, (line - 1) // 3 * 3 + 4 AS line_end, path || '#' || (line - 1) // 3 AS chunk_id FROM chunks GROUP BY ALL"


def overlapping_windows(spark, sf_dir):
    """Windows of four lines, every three: neighbours share a line, so the first one in order counts."""
    at = F.floor((F.col("line") - 1) / 3)
    rows = corpus.chunks(spark, sf_dir).select("path", at.alias("ord")).distinct()
    return rows.select("path", "ord", (F.col("ord") * 3 + 1).alias("line_start"), (F.col("ord") * 3 + 4).alias("line_end"), F.concat("path", F.lit("#"), "ord").alias("chunk_id"))


@register(f"WITH {corpus.SQL}, w AS ({WINDOWS}) SELECT c.chunk_id AS ref_id, min_by(w.chunk_id, ord) AS chunk_id FROM chunks c LEFT JOIN w ON c.path = w.path AND line BETWEEN line_start AND line_end GROUP BY 1")
def edge_range_join(spark, sf_dir):
    points = corpus.chunks(spark, sf_dir).select("path", F.col("chunk_id").alias("ref_id"), "line")
    return graph.covering_chunk(points, overlapping_windows(spark, sf_dir)).select("ref_id", "chunk_id")


@register("""WITH refs AS (SELECT DISTINCT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS ref_id, l_suppkey AS path, l_partkey % 10 AS name, CAST(l_quantity AS BIGINT) AS line FROM lineitem),
symbols AS (SELECT p_partkey AS symbol_id, p_partkey % 100 + 1 AS path, p_partkey % 10 AS name, CAST(p_size AS BIGINT) AS declared FROM part)
SELECT ref_id, min_by(symbol_id, (CASE WHEN declared > line THEN 1 ELSE 0 END) * 1000000000 + symbol_id) AS symbol_id FROM refs LEFT JOIN symbols USING (path, name) GROUP BY ref_id""")
def local_symbol_first(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("ref_id"), F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 10).alias("name"), F.col("l_quantity").cast("long").alias("line")).distinct()
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 100 + 1).alias("path"), (F.col("p_partkey") % 10).alias("name"), F.col("p_size").cast("long").alias("line_start"), F.col("p_partkey").alias("ord"))
    return graph.local_symbols(refs, symbols).select("ref_id", "symbol_id")


@register(r"""WITH imports AS (SELECT doc_id AS ref_id, 'src/' || lang || '/a.ts' AS path, CASE doc_id % 4 WHEN 0 THEN './m' || doc_id WHEN 1 THEN '../x/./m' || doc_id WHEN 2 THEN 'lib' ELSE './d' || doc_id END AS module FROM documents),
files AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'src/' || lang || '/m' || doc_id || '.tsx' WHEN 1 THEN 'src/x/m' || doc_id || '.js' ELSE 'src/' || lang || '/d' || doc_id || '/index.ts' END AS path FROM documents WHERE doc_id % 8 < 5)
SELECT ref_id, f.path AS target FROM imports LEFT JOIN files f ON f.path IN (SELECT CASE ref_id % 4 WHEN 0 THEN 'src/' || split_part(imports.path, '/', 2) || '/m' || ref_id || '.tsx' WHEN 1 THEN 'src/x/m' || ref_id || '.js' WHEN 3 THEN 'src/' || split_part(imports.path, '/', 2) || '/d' || ref_id || '/index.ts' END)""")
def module_resolution(spark, sf_dir):
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.when(n % 4 == 0, F.concat(F.lit("./m"), n)).when(n % 4 == 1, F.concat(F.lit("../x/./m"), n)).when(n % 4 == 2, F.lit("lib")).otherwise(F.concat(F.lit("./d"), n))
    imports = docs.select(n.alias("ref_id"), F.concat(F.lit("src/"), "lang", F.lit("/a.ts")).alias("path"), name.alias("module"))
    file = F.when(n % 4 == 0, F.concat(F.lit("src/"), "lang", F.lit("/m"), n, F.lit(".tsx"))).when(n % 4 == 1, F.concat(F.lit("src/x/m"), n, F.lit(".js"))).otherwise(F.concat(F.lit("src/"), "lang", F.lit("/d"), n, F.lit("/index.ts")))
    return graph.resolved_modules(imports, docs.where(n % 8 < 5).select(file.alias("path"))).select("ref_id", "target")


EDGES = """refs AS (SELECT l_orderkey % 500 AS chunk_id, l_partkey AS target_symbol_id, l_returnflag AS kind, l_linestatus AS name FROM lineitem),
symbols AS (SELECT p_partkey AS symbol_id, p_partkey % 500 AS chunk_id FROM part),
edges AS (SELECT refs.chunk_id, symbols.chunk_id AS target_chunk_id, kind, name FROM refs JOIN symbols ON symbol_id = target_symbol_id WHERE refs.chunk_id <> symbols.chunk_id)"""


def edges(spark, sf_dir):
    """Lines of orders as references, parts as symbols; 500 chunks."""
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("chunk_id"), F.col("l_partkey").alias("target_symbol_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("name"))
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 500).alias("chunk_id"))
    return graph.edges_out(refs, symbols)


@register(f"WITH {EDGES} SELECT chunk_id, kind, count(*) AS edges, count(DISTINCT target_chunk_id) AS targets FROM edges GROUP BY ALL")
def related_out(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("chunk_id", "kind").agg(F.count("*").alias("edges"), F.count_distinct("target_chunk_id").alias("targets"))


@register(f"WITH {EDGES} SELECT target_chunk_id AS chunk_id, count(DISTINCT chunk_id) AS sources FROM edges GROUP BY 1")
def related_in(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(F.col("target_chunk_id").alias("chunk_id")).agg(F.count_distinct(F.col("chunk_id")).alias("sources"))


@register(f"""WITH {EDGES}, c AS (SELECT 0 AS kind_rank, 'references' AS relation, target_chunk_id AS chunk_id FROM edges WHERE chunk_id = 7 UNION SELECT 1, 'referenced-by', chunk_id FROM edges WHERE target_chunk_id = 7
UNION SELECT 2, 'children', r FROM range(500) t(r) WHERE r // 10 = 7 UNION SELECT 3, 'parent', 0)
SELECT kind_rank, relation, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY kind_rank) AS f FROM c WHERE chunk_id <> 7) WHERE f = 1 ORDER BY kind_rank, chunk_id LIMIT 20""")
def related_dedupe(spark, sf_dir):
    parents = spark.range(500).select(F.col("id").alias("chunk_id"), F.floor(F.col("id") / 10).alias("parent_chunk_id"))
    chunks = spark.range(500).select(F.col("id").alias("chunk_id"), F.lit("f").alias("path"), F.lit(1).alias("line_start"))
    return graph.related(7, edges(spark, sf_dir), parents, chunks, 20).select("kind_rank", "relation", "chunk_id")
