"""Named queries: code units, index upkeep, audits, drift, ingest and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import inputs
from memlake.catalog.base import query, table
from memlake.operators import audit, code, index
from memlake.plans.indexing import chunk_documents, clean_view, keyword_rows, reindex
from memlake.plans.searching import search_code
from memlake.sources.ingest import ingest_chunks

_U = f"u AS ({inputs.UNITS_SQL})"


@query("code_prefilter", f"""
WITH {_U} SELECT path, chunk_name, start_line FROM u WHERE project = 'supp_1' AND chunk_type = 'class' AND NOT is_test AND contains(path, 'mod_4')""")
def code_prefilter(spark, sf_dir):
    seen = code.code_prefilter(inputs.units(spark, sf_dir), "supp_1", "class", root="mod_4")
    return seen.select("path", "chunk_name", "start_line")


@query("find_units", f"""
WITH {_U} SELECT path, chunk_name, start_line FROM u WHERE NOT is_test AND chunk_type = 'method' AND chunk_name IN (SELECT DISTINCT 'part_' || p_size FROM part)""")
def find_units(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.col("p_size").cast("string")).alias("chunk_name"))
    found = code.find_units(inputs.units(spark, sf_dir), names, "method")
    return found.select("path", "chunk_name", "start_line")


_OUTLINED = "path IN (SELECT DISTINCT x.path FROM u x, orders WHERE o_orderstatus = 'P' AND x.l_orderkey = o_orderkey)"


def _outline(spark, sf_dir, **options):
    """Outlines of the files of paused orders, each named by its file name only."""
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path")
    )
    found = code.file_outline(inputs.units(spark, sf_dir), asked, **options)
    return found.select("project", "path", "chunk_type", "chunk_name", "start_line", "skeleton_text")


@query("file_outline_names", f"""
WITH {_U} SELECT project, path, chunk_type, chunk_name, start_line, CASE WHEN chunk_type = 'imports' THEN skeleton_text END AS skeleton_text
FROM u WHERE chunk_type IN ('file', 'imports', 'namespace', 'class') AND {_OUTLINED}""")
def file_outline_names(spark, sf_dir):
    return _outline(spark, sf_dir, depth=1)


@query("file_outline_methods", f"""
WITH {_U} SELECT project, path, chunk_type, chunk_name, start_line, skeleton_text FROM u WHERE {_OUTLINED}""")
def file_outline_methods(spark, sf_dir):
    return _outline(spark, sf_dir, depth=2)


@query("file_outline_summary", f"""
WITH {_U} SELECT project, path, chunk_type, chunk_name, start_line, CASE WHEN chunk_type = 'imports' THEN skeleton_text END AS skeleton_text
FROM u WHERE {_OUTLINED}""")
def file_outline_summary(spark, sf_dir):
    return _outline(spark, sf_dir, depth=0, summary_only=True)


@query("project_map", f"""
WITH {_U}, p AS (SELECT DISTINCT string_split(path, '/') AS s FROM u WHERE chunk_type = 'file' AND NOT is_test),
c AS (SELECT s, least(2, len(s)) AS top, unnest(range(1, least(2, len(s)) + 1)) AS d FROM p)
SELECT array_to_string(s[1:d], '/') || CASE WHEN d < top THEN '/' ELSE '' END AS node,
  CASE WHEN d = 1 THEN '.' ELSE array_to_string(s[1:d - 1], '/') || '/' END AS parent, CAST(d AS INTEGER) AS depth, d = top AS is_leaf, count(*) AS n_files
FROM c GROUP BY ALL""")
def project_map(spark, sf_dir):
    paths = code.indexed_paths(inputs.units(spark, sf_dir), include_tests=False)
    return code.project_map(paths, 2)


@query("indexed_paths", f"WITH {_U} SELECT DISTINCT path FROM u WHERE chunk_type = 'file' AND project = 'supp_2'")
def indexed_paths(spark, sf_dir):
    return code.indexed_paths(inputs.units(spark, sf_dir), "supp_2")


@query("indexed_projects", f"WITH {_U} SELECT DISTINCT project FROM u")
def indexed_projects(spark, sf_dir):
    return code.indexed_projects(inputs.units(spark, sf_dir))


@query("test_flags", f"WITH {_U} SELECT path, regexp_matches(lower(path), 'tests/|test_') AS is_test, count(*) AS n FROM u GROUP BY ALL")
def test_flags(spark, sf_dir):
    units = inputs.units(spark, sf_dir).drop("is_test")
    return code.flag_tests(units).groupBy("path", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("file_summary", f"""
WITH {_U}, n AS (SELECT *, row_number() OVER (PARTITION BY project, path, chunk_type ORDER BY start_line, chunk_name) AS nth, count(*) OVER (PARTITION BY project, path, chunk_type) AS cnt
  FROM (SELECT 'all' AS project, 'mod_' || (l_orderkey % 50) AS path, chunk_type, chunk_name || '_' || l_orderkey AS chunk_name, l_orderkey * 100 + start_line AS start_line, l_orderkey * 100 + end_line AS end_line FROM u) x),
g AS (SELECT path, chunk_type, string_agg(chunk_name, ', ' ORDER BY nth) FILTER (nth <= 10) || CASE WHEN any_value(cnt) > 10 THEN '...' ELSE '' END AS names FROM n WHERE chunk_type IN ('class', 'method') GROUP BY ALL),
p AS (SELECT path, max(CASE WHEN chunk_type = 'class' THEN 'Classes: ' || names END) AS c, max(CASE WHEN chunk_type = 'method' THEN 'Methods: ' || names END) AS m FROM g GROUP BY path)
SELECT s.path, 'File Structure: ' || coalesce(nullif(concat_ws(' | ', c, m), ''), 'No structural units found.') AS skeleton_text, s.end_line
FROM (SELECT path, max(end_line) AS end_line FROM n GROUP BY path) s LEFT JOIN p USING (path)""")
def file_summary(spark, sf_dir):
    """Summaries of 50 large modules; each lists the first ten names of a kind."""
    u = inputs.units(spark, sf_dir)
    wide = u.select(
        F.lit("all").alias("project"), F.concat(F.lit("mod_"), (F.col("l_orderkey") % 50).cast("string")).alias("path"),
        "chunk_type", F.concat("chunk_name", F.lit("_"), F.col("l_orderkey").cast("string")).alias("chunk_name"),
        (F.col("l_orderkey") * 100 + F.col("start_line")).alias("start_line"),
        (F.col("l_orderkey") * 100 + F.col("end_line")).alias("end_line"),
    )
    return code.file_summary(wide).select("path", "skeleton_text", "end_line")


@query("import_summary", f"""
WITH {_U} SELECT project, path, string_agg('import ' || chunk_name, chr(10) ORDER BY start_line, 'import ' || chunk_name) AS skeleton_text FROM u WHERE chunk_type = 'imports' GROUP BY ALL""")
def import_summary(spark, sf_dir):
    lines = inputs.units(spark, sf_dir).where("chunk_type = 'imports'").select(
        "project", "path", F.col("start_line").alias("line"), F.concat(F.lit("import "), "chunk_name").alias("text")
    )
    return code.import_summary(lines).select("project", "path", "skeleton_text")


_POSITION = "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"


@query("dup_names", f"""
WITH {_U}, n AS (SELECT *, row_number() OVER (PARTITION BY project, d, chunk_type, chunk_name ORDER BY position) AS nth FROM (
  SELECT project, 'mod_' || (l_orderkey % 50) AS d, chunk_type, chunk_name, start_line, {_POSITION} AS position FROM u) x),
r AS (SELECT *, CASE WHEN nth = 1 THEN chunk_name ELSE chunk_name || '_L' || start_line END AS renamed FROM n),
s AS (SELECT *, row_number() OVER (PARTITION BY project, d, chunk_type, renamed ORDER BY position) AS same FROM r)
SELECT project, d AS path, chunk_type, position, CASE WHEN same = 1 THEN renamed ELSE renamed || '_' || nth END AS chunk_name FROM s""")
def dup_names(spark, sf_dir):
    u = inputs.units(spark, sf_dir, spread=True)
    rows = u.select(
        "project", F.concat(F.lit("mod_"), (F.col("l_orderkey") % 50).cast("string")).alias("path"), "chunk_type",
        "chunk_name", "start_line",
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    return code.dedupe_names(rows).select("project", "path", "chunk_type", "position", "chunk_name")


@query("index_profile", f"""
WITH {_U} SELECT project, count(*) AS total, count(*) FILTER (chunk_type = 'file') AS files, count(*) FILTER (is_test) AS tests,
  count(*) FILTER (NOT is_test) AS not_tests, count(*) FILTER (chunk_type = 'file' AND NOT is_test) AS files_not_tests FROM u GROUP BY project""")
def index_profile(spark, sf_dir):
    return audit.profile_index(inputs.units(spark, sf_dir))


@query("index_sample", f"WITH {_U} SELECT project, path, chunk_type, chunk_name, is_test FROM u ORDER BY ALL LIMIT 5")
def index_sample(spark, sf_dir):
    return audit.profile_sample(inputs.units(spark, sf_dir))


# The batch holds the files of orders placed after 1998 with new text; those of low priority are cleared.
_BATCH = f"""
{_U}, f AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) >= 1998),
kept AS (SELECT u.*, f.o_orderkey IS NOT NULL AS touched, coalesce(o_orderpriority, '') = '5-LOW' AS low FROM u LEFT JOIN f ON f.o_orderkey = l_orderkey)"""


def _merge_inputs(spark, sf_dir):
    u = inputs.units(spark, sf_dir)
    fresh = table(spark, sf_dir, "orders").where(F.year("o_orderdate") >= 1998)
    touched = u.join(fresh, F.col("l_orderkey") == F.col("o_orderkey"))
    low = F.col("o_orderpriority") == "5-LOW"
    cols = ["project", "path", "chunk_type", "chunk_name", "start_line", "skeleton_text", "l_quantity"]
    batch = touched.where(~low & (F.col("l_quantity") > 10)).withColumn("skeleton_text", F.upper("skeleton_text"))
    cleared = touched.where(low | (F.col("l_quantity") <= 10)).select("project", "path").distinct()
    return u.select(*cols), batch.select(*cols), cleared


@query("merge_units", f"""
WITH {_BATCH}, paths AS (SELECT DISTINCT project, path FROM kept WHERE touched)
SELECT project, path, chunk_type, chunk_name, start_line, skeleton_text FROM u WHERE (project, path) NOT IN (SELECT (project, path) FROM paths)
UNION ALL SELECT project, path, chunk_type, chunk_name, start_line, upper(skeleton_text) FROM kept WHERE touched AND NOT low AND l_quantity > 10""")
def merge_units(spark, sf_dir):
    target, batch, cleared = _merge_inputs(spark, sf_dir)
    merged = index.merge_units(target, batch, cleared)
    return merged.drop("l_quantity")


@query("merge_report", f"""
WITH {_BATCH}, b AS (SELECT project, path, chunk_type, chunk_name, start_line FROM kept WHERE touched AND NOT low AND l_quantity > 10)
SELECT (SELECT count(*) FROM b) AS updated, CAST(0 AS BIGINT) AS inserted, (SELECT count(*) FROM kept k WHERE (project, path) IN (SELECT (project, path) FROM kept WHERE touched)) - (SELECT count(*) FROM b) AS deleted""")
def merge_report(spark, sf_dir):
    target, batch, cleared = _merge_inputs(spark, sf_dir)
    nth = lambda df: df.withColumn("chunk_name", F.concat_ws("/", "chunk_name", "start_line", F.lower("skeleton_text")))
    return index.merge_report(nth(target), nth(batch), cleared)


@query("upsert_by_path", """
SELECT 'c/' || c_custkey AS path, CASE WHEN o.o_custkey IS NULL THEN c_name ELSE 'orders of ' || c_custkey END AS content
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey""")
def upsert_by_path(spark, sf_dir):
    path = lambda c: F.concat(F.lit("c/"), F.col(c).cast("string")).alias("path")
    target = table(spark, sf_dir, "customer").select(path("c_custkey"), F.col("c_name").alias("content"))
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        path("o_custkey"), F.concat(F.lit("orders of "), F.col("o_custkey").cast("string")).alias("content")
    ).distinct()
    known = late.join(target.select("path"), "path", "left_semi")
    return index.upsert_by_path(target, known)


@query("delete_paths", f"""
WITH {_U}, d AS (SELECT DISTINCT u.project, u.path FROM u JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
SELECT project, path, count(*) AS deleted, (SELECT count(*) FROM u WHERE (project, path) NOT IN (SELECT (project, path) FROM d)) AS remaining
FROM u WHERE (project, path) IN (SELECT (project, path) FROM d) GROUP BY ALL""")
def delete_paths(spark, sf_dir):
    u = inputs.units(spark, sf_dir)
    gone = u.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_orderkey") == F.col("l_orderkey"))
    left, deleted = index.delete_paths(u, gone.select("project", "path"))
    return deleted.withColumn("remaining", left.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("rename_paths", f"""
WITH {_U}, i AS (SELECT path, chunk_name, start_line, l_orderkey FROM u WHERE chunk_type IN ('class', 'method')),
r AS (SELECT DISTINCT path AS old_path, 'moved/' || path AS new_path FROM u JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
SELECT coalesce(new_path, path) AS path, chunk_name, start_line, 'row' AS kind FROM i LEFT JOIN r ON path = old_path
UNION ALL SELECT new_path, old_path, NULL, 'fallback' FROM r WHERE old_path NOT IN (SELECT path FROM i)""")
def rename_paths(spark, sf_dir):
    """Files of paused orders move; those without class or method rows come back for indexing."""
    u = inputs.units(spark, sf_dir)
    idx = u.where("chunk_type IN ('class', 'method')").select("path", "chunk_name", "start_line")
    moved = u.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_orderkey") == F.col("l_orderkey"))
    renames = moved.select(F.col("path").alias("old_path"), F.concat(F.lit("moved/"), "path").alias("new_path")).distinct()
    rows, fallback = index.rename_paths(idx, renames)
    again = fallback.select(
        F.col("new_path").alias("path"), F.col("old_path").alias("chunk_name"),
        F.lit(None).cast("int").alias("start_line"), F.lit("fallback").alias("kind"),
    )
    return rows.withColumn("kind", F.lit("row")).unionByName(again)


@query("ghost_prune", """
WITH live AS (SELECT DISTINCT 'c/' || o_custkey AS path FROM orders WHERE o_totalprice > 400000),
c AS (SELECT 'c/' || c_custkey AS path, c_name AS v FROM customer), k AS (SELECT 'c/' || o_custkey AS path, o_orderkey AS v FROM orders),
g AS (SELECT path FROM c WHERE path NOT IN (SELECT path FROM live))
SELECT 'chunks' AS part, path, count(*) AS n FROM c WHERE path NOT IN (SELECT path FROM g) GROUP BY path
UNION ALL SELECT 'keywords', path, count(*) FROM k WHERE path NOT IN (SELECT path FROM g) GROUP BY path
UNION ALL SELECT 'ghost', path, 1 FROM g""")
def ghost_prune(spark, sf_dir):
    path = lambda c: F.concat(F.lit("c/"), F.col(c).cast("string")).alias("path")
    orders = table(spark, sf_dir, "orders")
    tables = {
        "chunks": table(spark, sf_dir, "customer").select(path("c_custkey"), "c_name"),
        "keywords": orders.select(path("o_custkey"), "o_orderkey"),
    }
    kept, ghosts = index.prune_ghosts(tables, orders.where("o_totalprice > 400000").select(path("o_custkey")))
    counted = [
        df.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "path", "n")
        for name, df in kept.items()
    ]
    gone = ghosts.select(F.lit("ghost").alias("part"), "path", F.lit(1).cast("long").alias("n"))
    return counted[0].unionByName(counted[1]).unionByName(gone)


_AUDIT = f"""
t AS ({inputs.TASKS_SQL}), i AS (SELECT key, file_path, status, title FROM t WHERE priority <> 'critical'),
d AS (SELECT file_path, CASE WHEN type = 'TD' THEN 'open' ELSE status END AS status, CASE WHEN project = 'market_3' THEN upper(title) ELSE title END AS title,
  CASE WHEN project = 'market_4' THEN 'bad block' END AS error FROM t WHERE priority <> 'high'),
j AS (SELECT coalesce(i.file_path, d.file_path) AS file_path, key, i.status AS a, d.status AS b, i.title AS x, d.title AS y, error, i.file_path IS NULL AS no_i, d.file_path IS NULL AS no_d FROM i FULL JOIN d USING (file_path)),
f AS (SELECT file_path, key, 'orphan' AS finding, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS index_value, CAST(NULL AS VARCHAR) AS doc_value FROM j WHERE no_d
  UNION ALL SELECT file_path, key, 'dangling', NULL, NULL, NULL FROM j WHERE no_i
  UNION ALL SELECT file_path, key, 'unreadable', NULL, NULL, error FROM j WHERE NOT no_i AND NOT no_d AND error IS NOT NULL
  UNION ALL SELECT file_path, key, 'mismatch', 'status', a, b FROM j WHERE NOT no_i AND NOT no_d AND error IS NULL AND a <> b
  UNION ALL SELECT file_path, key, 'mismatch', 'title', x, y FROM j WHERE NOT no_i AND NOT no_d AND error IS NULL AND x <> y)"""


def _audit_inputs(spark, sf_dir):
    t = inputs.tasks(spark, sf_dir)
    docs = t.where("priority <> 'high'").select(
        "file_path", F.when(F.col("type") == "TD", "open").otherwise(F.col("status")).alias("status"),
        F.when(F.col("project") == "market_3", F.upper("title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("project") == "market_4", "bad block").alias("error"),
    )
    return t.where("priority <> 'critical'").select("key", "file_path", "status", "title"), docs


@query("integrity_audit", f"WITH {_AUDIT} SELECT * FROM f")
def integrity_audit(spark, sf_dir):
    return audit.audit(*_audit_inputs(spark, sf_dir))


@query("integrity_summary", f"""
WITH {_AUDIT} SELECT 'unhealthy' AS status, count(*) FILTER (finding = 'orphan') AS orphans, count(*) FILTER (finding = 'dangling') AS dangling,
  count(*) FILTER (finding IN ('mismatch', 'unreadable')) AS inconsistencies, (SELECT count(*) FROM i) AS total_index_records FROM f""")
def integrity_summary(spark, sf_dir):
    idx, docs = _audit_inputs(spark, sf_dir)
    return audit.audit_summary(idx, audit.audit(idx, docs))


_COS = "SELECT e.vec_id AS key, list_sum(list_transform(e.embedding, lambda v, i: CAST(v AS DOUBLE) * CAST(CAST(v + CASE WHEN i = 1 THEN 0.01 ELSE 0 END AS FLOAT) AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) * sqrt(list_sum(list_transform(e.embedding, lambda v, i: CAST(CAST(v + CASE WHEN i = 1 THEN 0.01 ELSE 0 END AS FLOAT) AS DOUBLE) ^ 2)))) AS cosine FROM embeddings e"


@query("drift_check", f"""
WITH c AS ({_COS}) SELECT count(*) AS pairs, round(avg(cosine), 6) AS mean_cosine, round(min(cosine), 6) AS min_cosine, avg(cosine) >= 0.999 AND min(cosine) >= 0.99 AS passed FROM c""")
def drift_check(spark, sf_dir):
    """Embeddings against a copy whose first component was moved a little."""
    now = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS key", "embedding AS vector")
    moved = F.transform("vector", lambda v, i: (v + F.when(i == 0, 0.01).otherwise(0.0)).cast("float"))
    report = audit.embedding_drift(now, now.select("key", moved.alias("vector")))
    return report.withColumn("mean_cosine", F.round("mean_cosine", 6)).withColumn("min_cosine", F.round("min_cosine", 6))


@query("keyword_states", f"""
WITH m AS ({inputs.MARKDOWN_SQL}) SELECT role, CASE role WHEN 'user' THEN 'missing' WHEN 'system' THEN 'empty' ELSE 'extracted' END AS keyword_state, count(*) AS n FROM m GROUP BY ALL""")
def keyword_states(spark, sf_dir):
    """One line range per document; user turns were never processed, system turns kept nothing."""
    md = inputs.markdown(spark, sf_dir)
    span = md.select("path", F.lit(1).alias("start_line"), F.lit(4).alias("end_line"), "role")
    lane = span.where("role <> 'user'").withColumn("keywords", F.when(F.col("role") == "system", "").otherwise("f1"))
    states = index.chunk_keywords(span, lane.drop("role"))
    return states.groupBy("role", "keyword_state").agg(F.count(F.lit(1)).alias("n"))


@query("reindex_dry_run", "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS blank FROM documents")
def reindex_dry_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True).select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content")
    )
    return reindex(docs, dry_run=True)


@query("markdown_keywords", f"""
WITH m AS ({inputs.MARKDOWN_SQL})
SELECT path, 'nasa' AS keywords, 'Tail' AS part FROM m
UNION ALL SELECT path, 'f' || conv_id || ' td-' || turn || ' docs/conv_' || conv_id || '.md', 'Notes' FROM m WHERE role <> 'system'""")
def markdown_keywords(spark, sf_dir):
    """Keywords of the generated chunks, by the heading they stand under."""
    chunks = chunk_documents(clean_view(inputs.markdown(spark, sf_dir)))
    rows = keyword_rows(chunks.where(F.col("section").rlike("### (Notes|Tail)$")))
    return rows.select("path", "keywords", F.regexp_extract("section", r"### (\w+)$", 1).alias("part"))


# --- ingest ----------------------------------------------------------------------------------

_INGEST = """
d AS (SELECT vec_id, label, CASE WHEN label = 0 THEN '0.9' ELSE '1.0' END AS version, CASE WHEN label = 1 THEN 'widget' ELSE 'class' END AS kind FROM embeddings)"""


def _deliveries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    unit = lambda kind, name, vec: F.struct(
        kind.alias("type"), name.alias("name"), F.lit("class X").alias("skeleton_text"), vec.alias("vector"),
        F.lit(3).alias("line_start"), F.lit(9).alias("line_end"),
    )
    vec, label = F.col("embedding"), F.col("label")
    short = F.when(label == 2, F.slice(vec, 1, 10)).otherwise(vec)
    chunks = F.array(
        unit(F.lit("file"), F.lit("file"), vec),
        unit(F.when(label == 1, "widget").otherwise("class"), F.concat(F.lit("c"), F.col("vec_id").cast("string")), short),
    )
    body = F.struct(
        F.when(label == 0, "0.9").otherwise("1.0").alias("schema_version"), F.lit("kb").alias("project_name"),
        F.concat(F.lit("src/test_"), F.col("vec_id").cast("string"), F.lit(".py")).alias("path"),
        F.lit("summary").alias("file_summary"),
        F.when(label == 3, F.array().cast("array<struct<type:string,name:string,skeleton_text:string,vector:array<float>,line_start:int,line_end:int>>")).otherwise(chunks).alias("chunks"),
    )
    payload = F.when(label == 4, F.lit("{broken")).otherwise(F.to_json(body))
    return e.select(F.col("vec_id").alias("delivery"), payload.alias("payload"))


@query("ingest_chunks", f"""
WITH {_INGEST}
SELECT vec_id AS delivery, 'src/test_' || vec_id || '.py' AS path, 'file' AS chunk_type, 'file' AS chunk_name, TRUE AS is_test, 64 AS width FROM d WHERE label NOT IN (0, 2, 3, 4)
UNION ALL SELECT vec_id, 'src/test_' || vec_id || '.py', 'class', 'c' || vec_id, TRUE, 64 FROM d WHERE label NOT IN (0, 1, 2, 3, 4)""")
def ingest(spark, sf_dir):
    units, _ = ingest_chunks(_deliveries(spark, sf_dir), 64, F.timestamp_micros(F.lit(0)))
    return units.select("delivery", "path", "chunk_type", "chunk_name", "is_test", F.size("vector").alias("width"))


@query("ingest_rejects", f"""
WITH {_INGEST}
SELECT vec_id AS delivery, CASE WHEN label = 4 THEN NULL ELSE 'src/test_' || vec_id || '.py' END AS path, CAST(CASE WHEN label = 1 THEN 1 END AS INTEGER) AS position,
  CASE label WHEN 0 THEN 'schema_version_mismatch' WHEN 1 THEN 'malformed chunk: type' WHEN 2 THEN 'vector must have 64 dimensions' WHEN 3 THEN 'chunks list must not be empty' ELSE 'unreadable payload' END AS reason
FROM d WHERE label IN (0, 1, 2, 3, 4)""")
def ingest_rejects(spark, sf_dir):
    _, rejects = ingest_chunks(_deliveries(spark, sf_dir), 64, F.timestamp_micros(F.lit(0)))
    return rejects


# --- reports ---------------------------------------------------------------------------------

@query("failed_alarm", """
SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') >= 100 AS alarm FROM events""")
def failed_alarm(spark, sf_dir):
    ledger = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    return audit.failed_alarm(ledger)


@query("run_report", """
WITH s AS (SELECT event_type AS step, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'created' END AS outcome, 'event ' || event_id AS message FROM events)
SELECT count(*) AS steps, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors,
  FALSE AS ok, (SELECT string_agg(step || ': ' || message, chr(10) ORDER BY step, message) FROM (SELECT * FROM s WHERE outcome = 'error' ORDER BY step, message LIMIT 100) x) AS messages FROM s""")
def run_report(spark, sf_dir):
    kind = F.col("event_type")
    steps = table(spark, sf_dir, "events").select(
        kind.alias("step"), F.when(kind == "error", "error").when(kind == "view", "skipped").otherwise("created").alias("outcome"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
    )
    return audit.run_report(steps)


@query("search_code", f"""
WITH c AS (SELECT 'src/' || p_brand || '/' || p_partkey || '.py' AS path, p_type AS project, p_name || ' of ' || p_brand || ' size ' || p_size AS text FROM part),
qs AS (SELECT DISTINCT p_name AS qid, 'code ' || p_name || ' size ' || length(p_name) AS text FROM part),
cv AS MATERIALIZED ({inputs.hashed_sql("SELECT * FROM c WHERE project = 'ECONOMY'", 'path', 'text', None)}),
qv AS MATERIALIZED ({inputs.hashed_sql('SELECT * FROM qs', 'qid', 'text', None)}),
near AS ({inputs.near_sql('qv', 'cv', 'qid', 'path', 10)})
SELECT n.qid, CAST(n.rank AS INTEGER) AS rank, n.path, c.text AS skeleton_text, round(n.distance, 4) AS distance FROM near n JOIN c USING (path)""")
def code_search(spark, sf_dir):
    from memlake.functions.embedding import embed

    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    units = part.select(
        F.col("p_type").alias("project"),
        F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
        F.lit("class").alias("chunk_type"), F.lit("c").alias("chunk_name"),
        F.concat("p_name", F.lit(" of "), "p_brand", F.lit(" size "), size).alias("skeleton_text"),
        F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(False).alias("is_test"),
    )
    names = part.select("p_name").distinct()
    queries = names.select(
        F.col("p_name").alias("qid"),
        F.concat(F.lit("code "), "p_name", F.lit(" size "), F.length("p_name").cast("string")).alias("query"),
    )
    found = search_code(queries, embed(units, "skeleton_text", cap=None), project="ECONOMY", chunk_type="class")
    return found.select("qid", "rank", "path", "skeleton_text", F.round("distance", 4).alias("distance"))
