"""Named queries: index runs end to end, remaining read and merge branches, and the extension points."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from memlake.catalog import inputs
from memlake.catalog.base import query, table
from memlake.catalog.history import _page_files
from memlake.catalog.search import _BM25_SQL, _CHUNKED, _WINDOWS, _passages
from memlake.catalog.texts import _MD, _TURN
from memlake.functions import embedding, rules
from memlake.functions.chunking import CHUNKS
from memlake.functions.exprs import raw_lines
from memlake.operators import edits, index, reading
from memlake.operators.retrieval import bm25, bm25_stats, document_frequency
from memlake.plans import assemble, indexing, registry, searching
from memlake.session import scratch_path
from memlake.sources.corpus import scan_code_rejects
from memlake.sources.tasks import write_task_documents


def _path(prefix, column, ext):
    return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(ext)).alias("path")


# --- reads and scans -------------------------------------------------------------------------

@query("read_modes", f"""
WITH {_MD}, r AS (SELECT *, unnest(['full', 'lines', 'section', 'peek']) AS mode FROM md)
SELECT path, mode, md5(CASE mode WHEN 'full' THEN substr(content, 1, length(content) - 1)
    WHEN 'lines' THEN array_to_string(string_split(content, chr(10))[2:4], chr(10))
    WHEN 'section' THEN CASE WHEN role <> 'system' THEN rtrim(substr(content, {_TURN}, strpos(content, '## not a heading') - {_TURN}), chr(10)) END END) AS digest,
  CASE WHEN mode = 'peek' THEN 'Unknown read mode: peek'
    WHEN mode = 'section' AND role = 'system' THEN 'Section ''Turn ' || turn || ''' not found in ' || path || '.' END AS error
FROM r""")
def read_modes(spark, sf_dir):
    """Every document read whole, by lines, by the section of its turn and in a mode that is none."""
    md = inputs.markdown(spark, sf_dir)
    modes = F.explode(F.array(*map(F.lit, ["full", "lines", "section", "peek"])))
    asked = md.select("path", "turn", modes.alias("mode")).select(
        F.concat_ws("|", "path", "mode").alias("rid"), "path", "mode",
        F.when(F.col("mode") == "section", F.format_string("Turn %d", "turn")).alias("section_name"),
        F.when(F.col("mode") == "lines", 2).alias("start_line"), F.when(F.col("mode") == "lines", 4).alias("end_line"),
    )
    read = reading.read_docs(asked, md.select("path", "content"))
    return read.select("path", "mode", F.md5("text").alias("digest"), "error")


_LARGEST = 3000


@query("scan_code_rejects", f"""
SELECT page_id, CAST(strlen(html) + 1 AS BIGINT) AS length, 'too large' AS reason FROM pages WHERE strlen(html) + 1 > {_LARGEST}""")
def code_rejects(spark, sf_dir):
    """Files over a bound that the caller set; without one none is too large."""
    found = scan_code_rejects(spark, _page_files(spark, sf_dir, "rejects"), [".txt"], max_bytes=_LARGEST)
    page = F.regexp_extract("path", r"page=(\d+)/", 1).cast("long")
    return found.select(page.alias("page_id"), "length", "reason")


# --- merges ----------------------------------------------------------------------------------

_NATIONS = """
t AS (SELECT 'n/' || c_nationkey AS path, 'method' AS chunk_type, c_name AS chunk_name, 'old' AS skeleton_text, c_acctbal, c_nationkey FROM customer),
b AS (SELECT path, chunk_type, chunk_name, 'new' AS skeleton_text FROM t WHERE c_acctbal > 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)
  UNION ALL SELECT 'n/' || s_nationkey, 'class', s_name, 'new' FROM supplier WHERE s_acctbal > 0)"""


def _nation_merge(spark, sf_dir):
    """Customers of a nation as its units; nations with a paid supplier are delivered anew, suppliers included."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    unit = lambda nation, kind, name, text: [
        _path("n/", nation, ""), F.lit(kind).alias("chunk_type"), F.col(name).alias("chunk_name"), F.lit(text).alias("skeleton_text")
    ]
    target = c.select(*unit("c_nationkey", "method", "c_name", "old"))
    asked = s.select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    again = c.where("c_acctbal > 0").join(asked, "c_nationkey", "left_semi")
    batch = again.select(*unit("c_nationkey", "method", "c_name", "new"))
    return target, batch.unionByName(s.select(*unit("s_nationkey", "class", "s_name", "new")))


@query("merge_inserts", f"""
WITH {_NATIONS} SELECT path, chunk_type, chunk_name, skeleton_text FROM t WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT * FROM b""")
def merge_inserts(spark, sf_dir):
    target, batch = _nation_merge(spark, sf_dir)
    return index.merge_units(target, batch, on=["path"])


@query("merge_inserts_report", f"""
WITH {_NATIONS}, o AS (SELECT * FROM t WHERE path IN (SELECT path FROM b))
SELECT (SELECT count(*) FROM o SEMI JOIN b USING (path, chunk_type, chunk_name)) AS updated,
  (SELECT count(*) FROM b ANTI JOIN o USING (path, chunk_type, chunk_name)) AS inserted,
  (SELECT count(*) FROM o ANTI JOIN b USING (path, chunk_type, chunk_name)) AS deleted""")
def merge_inserts_report(spark, sf_dir):
    target, batch = _nation_merge(spark, sf_dir)
    return index.merge_report(target, batch, on=["path"])


# --- whole index runs ------------------------------------------------------------------------

def _indexed(tables):
    lines = ["path", "start_line", "end_line"]
    return tables.chunks.join(tables.keywords.select(*lines, "keywords"), lines).join(
        tables.documents.where(F.col("vector").isNotNull()).select("path"), "path"
    )


@query("reindex_run", """
SELECT 'o/' || o_orderkey || '.txt' AS path, CASE WHEN o_orderstatus <> 'P' THEN 'Order ORD-' || o_orderkey || ' waits for stock' END AS text,
  CASE WHEN o_orderstatus <> 'P' THEN 'ord-' || o_orderkey END AS keywords, CASE WHEN o_orderstatus = 'P' THEN 'no content' END AS reason FROM orders""")
def reindex_run(spark, sf_dir):
    """The whole index written and read back; documents without content are set aside with a reason."""
    body = F.concat(F.lit("Order ORD-"), F.col("o_orderkey").cast("string"), F.lit(" waits for stock"))
    docs = table(spark, sf_dir, "orders", spread=True).select(
        _path("o/", "o_orderkey", ".txt"), F.when(F.col("o_orderstatus") != "P", body).alias("content")
    )
    kept = indexing.write_index(indexing.reindex(docs), scratch_path(spark, "reindex"), files=2)
    none = F.lit(None).cast("string")
    good = _indexed(kept).select("path", "text", "keywords", none.alias("reason"))
    bad = indexing.reindex_rejects(docs).select("path", none.alias("text"), none.alias("keywords"), "reason")
    return good.unionByName(bad)


_ACCOUNT_EDITS = """
a AS (SELECT 'c/' || c_custkey || '.txt' AS path, c_custkey, CASE WHEN c_acctbal < 0 THEN 'replace_file' WHEN c_acctbal > 9000 THEN 'bogus'
  WHEN c_acctbal > 8000 THEN 'blank' WHEN c_acctbal > 7000 THEN 'create' ELSE 'none' END AS kind FROM customer)"""


def _account_edits(spark, sf_dir):
    """Accounts as documents: some are written anew, some by an unknown mode, some with nothing."""
    c, balance, key = table(spark, sf_dir, "customer"), F.col("c_acctbal"), F.col("c_custkey").cast("string")
    docs = c.select(_path("c/", "c_custkey", ".txt"), F.concat(F.lit("Account ACC-"), key, F.lit(" stays open")).alias("content"))
    mode = F.when(balance < 0, "replace_file").when(balance > 9000, "bogus").when(balance > 8000, "replace_file").when(balance > 7000, "create")
    text = F.when((balance > 8000) & (balance <= 9000), " \n").otherwise(F.concat(F.lit("Account NEW-"), key, F.lit(" is closed now")))
    batch = c.select(F.col("c_custkey").alias("seq"), _path("c/", "c_custkey", ".txt"), mode.alias("mode"), text.alias("content"))
    return docs, batch.where(F.col("mode").isNotNull())


@query("edit_reindex", f"""
WITH {_ACCOUNT_EDITS} SELECT path, CASE WHEN kind IN ('replace_file', 'create') THEN 'Account NEW-' || c_custkey || ' is closed now' ELSE 'Account ACC-' || c_custkey || ' stays open' END AS text,
  CASE WHEN kind IN ('replace_file', 'create') THEN 'new-' ELSE 'acc-' END || c_custkey AS keywords FROM a""")
def edit_reindex(spark, sf_dir):
    """Edits applied, then exactly the documents they changed are indexed anew."""
    docs, batch = _account_edits(spark, sf_dir)
    result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    tables = indexing.build_index(docs)
    fresh = indexing.refresh_index(tables, result.docs, indexing.changed_paths(result.results))
    return _indexed(fresh).select("path", "text", "keywords")


@query("replace_file_results", f"""
WITH {_ACCOUNT_EDITS} SELECT path, CASE WHEN kind IN ('replace_file', 'create') THEN 'success' ELSE 'error' END AS status,
  CASE kind WHEN 'bogus' THEN 'Unknown write mode: bogus' WHEN 'blank' THEN 'Mode ''replace_file'' requires non-empty content.'
    ELSE 'Applied ' || kind || ' to memory successfully. File saved.' END AS message FROM a WHERE kind <> 'none'""")
def replace_file_results(spark, sf_dir):
    docs, batch = _account_edits(spark, sf_dir)
    result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    return result.results.select("path", "status", "message")


@query("task_documents_written", f"""
WITH t AS ({inputs.TASKS_SQL})
SELECT CASE status WHEN 'closed' THEN 'done' WHEN 'paused' THEN 'paused' ELSE 'active' END AS status_dir, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(min(id) AS BIGINT) AS first_id
FROM t GROUP BY ALL""")
def task_documents_written(spark, sf_dir):
    """Task documents written by state and year, and read back from those folders."""
    target = scratch_path(spark, "tasks")
    write_task_documents(inputs.tasks(spark, sf_dir), target)
    back = spark.read.parquet(target)
    number = F.regexp_extract("content", r"(?m)^id: (\d+)$", 1).cast("long")
    return back.groupBy("status_dir", F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("first_id")
    )


# --- searches over stored statistics and without a keyword table ----------------------------------

@query("bm25_stored", _BM25_SQL)
def bm25_stored(spark, sf_dir):
    """Statistics written with the index; the search reads the corpus once, for the scores."""
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id AS qid", "text AS query")
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    root = scratch_path(spark, "statistics")
    bm25_stats(docs, "text").write.parquet(f"{root}/stats")
    document_frequency(docs, "text").write.parquet(f"{root}/terms")
    top = bm25(
        queries, docs, 5, keys=["doc_id"], text="text",
        stats=spark.read.parquet(f"{root}/stats"), frequency=spark.read.parquet(f"{root}/terms"),
    )
    return top.select("qid", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("hybrid_vector_only", f"""
WITH {_WINDOWS}, {_CHUNKED},
near AS ({inputs.near_sql('qv', 'cv', 'qid', 'path, start_line, end_line, section', 5)})
SELECT qid, CAST(rank AS INTEGER) AS rank, path, section, 'vector' AS match FROM near""")
def hybrid_vector_only(spark, sf_dir):
    """Hybrid search where no keyword table was built."""
    _, chunks, queries = _passages(spark, sf_dir)
    found = searching.hybrid_search(queries, chunks, None, k=5)
    return found.select("qid", "rank", "path", "section", "match")


# --- extension points ------------------------------------------------------------------------

@contextmanager
def _registered(entries, name, *more):
    """An entry that is there while a plan is built."""
    try:
        yield
    finally:
        for held in (entries, *more):
            held.pop(name, None)


@query("custom_encoder", """
WITH p AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, CAST(len(string_split(t, ' ')) AS BIGINT) AS words FROM p WHERE t <> ''""")
def custom_encoder(spark, sf_dir):
    """Documents embedded by an encoder registered under its own name: their length in characters and words."""
    lengths = lambda t: F.when(t.isNotNull(), F.array(F.length(t), F.size(F.split(t, " ", -1))).cast("array<float>"))
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    embedding.register_encoder("lengths", lambda: lengths)
    with _registered(embedding._ENCODERS, "lengths"):
        rows = embedding.embed(docs, "text", encode="lengths").where(F.col("vector").isNotNull())
    part = lambda i, name: F.col("vector")[i].cast("long").alias(name)
    return rows.select("doc_id", part(0, "chars"), part(1, "words"))


def _part_docs(spark, sf_dir, ext):
    return table(spark, sf_dir, "part").select(
        _path("p/", "p_partkey", ext), F.concat("p_name", F.lit("\n"), "p_brand").alias("content")
    )


@query("custom_extractor", "SELECT 'p/' || p_partkey || '.txt' AS path, lower(p_brand) AS keywords FROM part")
def custom_extractor(spark, sf_dir):
    """Keywords by a registered extractor: the last line of a chunk."""
    last = lambda section, text: F.struct(
        F.array(F.lower(F.substring_index(text, "\n", -1))).alias("kept"), F.array().cast("array<string>").alias("dropped")
    )
    registry.register_extractor("last_line", last)
    with _registered(registry.EXTRACTORS, "last_line"):
        rows = indexing.keyword_rows(indexing.chunk_documents(_part_docs(spark, sf_dir, ".txt")), "last_line")
    return rows.select("path", "keywords")


@query("custom_chunker", """
SELECT 'p/' || p_partkey || '.csv' AS path, CAST(unnest([1, 2]) AS INTEGER) AS line, unnest([p_name, p_brand]) AS text FROM part""")
def custom_chunker(spark, sf_dir):
    """Documents of an extension with its own chunker: one chunk for each line."""
    def by_line(text, max_chars, overlap):
        row = lambda t, i: F.struct(F.lit("").alias("section"), (i + 1).alias("start_line"), (i + 1).alias("end_line"), t.alias("text"))
        return F.transform(raw_lines(text), row).cast(CHUNKS)

    registry.register_chunker(".csv", by_line)
    with _registered(registry.CHUNKERS, ".csv"):
        chunks = indexing.chunk_documents(_part_docs(spark, sf_dir, ".csv"))
    return chunks.select("path", F.col("start_line").alias("line"), "text")


@query("custom_mode", """
SELECT 'p/' || p_partkey || '.md' AS path, p_name || chr(10) || p_brand || chr(10) || p_type AS content, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_size <> 1
UNION ALL SELECT 'p/' || p_partkey || '/sealed.md', p_name || chr(10) || p_brand, 'This log is sealed.' FROM part WHERE p_size = 1""")
def custom_mode(spark, sf_dir):
    """A registered write mode that adds a line, and a registered guard for documents of one name."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") == 1, "/sealed.md").otherwise(".md")).alias("path")
    docs = p.select(path, F.concat("p_name", F.lit("\n"), "p_brand").alias("content"))
    batch = p.select(F.col("p_partkey").alias("seq"), path, F.lit("add_line").alias("mode"), F.col("p_type").alias("content"))
    none = F.lit(None).cast("string")
    add = lambda text, e: F.struct(F.concat(text, F.lit("\n"), e["content"]).alias("content"), none.alias("error"))
    registry.register_mode("add_line", add, ["content"])
    registry.register_hook("sealed.md", lambda text, e: F.lit("This log is sealed."))
    with _registered(edits.EDIT_MODES, "add_line", rules.MODE_FIELDS), _registered(edits.INTEGRITY_HOOKS, "sealed.md"):
        result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    error = F.when(F.col("status") == "error", F.col("message"))
    return result.docs.join(result.results.select("path", error.alias("error")), "path")


@query("custom_action", """
SELECT 'n' || n_regionkey AS project, CAST(n_nationkey AS INTEGER) AS step, upper(n_name) AS part, CAST(NULL AS VARCHAR) AS error FROM nation
UNION ALL SELECT 'n' || r_regionkey, 1000, NULL, 'Unknown pipeline action: ''whisper''' FROM region""")
def custom_action(spark, sf_dir):
    """Manifest steps of a registered action, and of one that nobody registered."""
    step = lambda region, nth, action, text: [
        F.concat(F.lit("n"), F.col(region).cast("string")).alias("project"), F.lit("all").alias("build"), F.lit("1").alias("version"),
        nth.cast("int").alias("step"), F.lit(action).alias("action"), F.col(text).alias("content"),
    ]
    loud = table(spark, sf_dir, "nation").select(*step("n_regionkey", F.col("n_nationkey"), "shout", "n_name"))
    soft = table(spark, sf_dir, "region").select(*step("r_regionkey", F.lit(1000), "whisper", "r_name"))
    docs = spark.createDataFrame([], "project string, path string, content string")
    registry.register_action("shout", lambda steps: steps.withColumn("text", F.upper("content")))
    with _registered(registry.ACTIONS, "shout"):
        parts = assemble.assemble_parts(loud.unionByName(soft), docs, "2024-01-31")
    return parts.select("project", "step", "part", "error")


@query("custom_existence", """
SELECT 'c/' || c_custkey AS path, c_custkey NOT IN (SELECT o_custkey FROM orders) AS ghost FROM customer""")
def custom_existence(spark, sf_dir):
    """Pruning by a registered strategy: a customer is alive as long as an order names it."""
    chunks = table(spark, sf_dir, "customer").select(_path("c/", "c_custkey", ""))
    registry.register_existence("orders", lambda orders: orders.select(_path("c/", "o_custkey", "")))
    with _registered(index.EXISTENCE, "orders"):
        kept, ghosts = index.prune_ghosts({"chunks": chunks}, table(spark, sf_dir, "orders"), existence="orders")
    return kept["chunks"].withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
