"""Named queries: nearest neighbours, chunking, keywords, BM25, fusion and search plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from memlake.catalog import inputs
from memlake.catalog.base import query, table
from memlake.functions.chunking import overlap_chunks
from memlake.functions.embedding import embed, linear_model
from memlake.functions.keywords import extract_keywords, identifier_terms
from memlake.operators.knn import knn_join
from memlake.operators.postings import bm25_postings, read_postings, write_postings
from memlake.operators.retrieval import bm25, bm25_stats, document_frequency, hydrate, limit_lanes, rrf
from memlake.operators.skew import top_k_per_key
from memlake.operators.vector_index import read_vector_index, search_vectors, write_vector_index
from memlake.plans import searching
from memlake.plans.indexing import chunk_documents, clean_view
from memlake.session import scratch_path


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding AS vector", "label")


_GAP = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ^ 2))"
_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _knn_oracle(distance: str, where: str = "true") -> str:
    return f"""
    SELECT qid, key, CAST(rank AS INTEGER) AS rank, round(distance, 4) AS distance FROM (
      SELECT qid, key, distance, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), key) AS rank
      FROM (SELECT a.vec_id AS qid, b.vec_id AS key, {distance} AS distance
            FROM embeddings a, embeddings b WHERE {where}) d) r
    WHERE rank <= 5"""


def _knn(spark, sf_dir, **options):
    v = _vectors(spark, sf_dir)
    near = knn_join(
        v.withColumnRenamed("vec_id", "qid"), v.withColumnRenamed("vec_id", "key"), 5, **options
    )
    return near.select("qid", "key", "rank", F.round("distance", 4).alias("distance"))


@query("knn_topk", _knn_oracle(_GAP))
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir)


@query("knn_cosine", _knn_oracle(f"1 - {_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')}) / sqrt({_DOT.format('b', 'b')})"))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, metric="cosine")


@query("knn_prefiltered", _knn_oracle(_GAP, "a.label = b.label"))
def knn_prefiltered(spark, sf_dir):
    """Every vector searches among the vectors of its own label."""
    return _knn(spark, sf_dir, by=["label"])


@query("knn_blocks", _knn_oracle(_GAP))
def knn_blocks(spark, sf_dir):
    """The plan for query sides beyond the broadcast bound: bounded blocks on both sides."""
    return _knn(spark, sf_dir, max_queries=200)


def _indexed(spark, sf_dir):
    root = scratch_path(spark, "vectors")
    v = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "key")
    write_vector_index(v, root, ["key"])
    return v.select(F.col("key").alias("qid"), "vector"), read_vector_index(spark, root)


@query("knn_indexed_exact", _knn_oracle(_GAP))
def knn_indexed_exact(spark, sf_dir):
    """A stored index, of which each query reads the lists that can hold a nearer row."""
    queries, index = _indexed(spark, sf_dir)
    return search_vectors(queries, index, 5).select("qid", "key", "rank", F.round("distance", 4).alias("distance"))


@query("knn_indexed", """
SELECT count(*) AS n_queries, count(*) * least(10, count(*)) AS n_found, true AS reached FROM embeddings""")
def knn_indexed(spark, sf_dir):
    """Rows that the nearest lists give, and whether 0.95 of the ten true neighbours are among them.

    A query looks into as many lists as reached a recall of 0.97 on the sample.
    """
    queries, index = _indexed(spark, sf_dir)
    found = search_vectors(queries, index, 10, recall=0.97).select("qid", "key", F.lit(True).alias("seen"))
    true = knn_join(queries, _vectors(spark, sf_dir).withColumnRenamed("vec_id", "key"), 10).select("qid", "key")
    both = found.join(true.withColumn("near", F.lit(True)), ["qid", "key"], "full_outer")
    return both.agg(
        F.count_distinct(F.when(F.col("seen"), F.col("qid"))).alias("n_queries"), F.count("seen").alias("n_found"),
        (F.count(F.when(F.col("seen") & F.col("near"), 1)) >= 0.95 * F.count("near")).alias("reached"),
    )


# --- chunking --------------------------------------------------------------------------------

WINDOWS_SQL = """
RECURSIVE win(doc_id, text, n, nth, pos, stop) AS (
  SELECT doc_id, text, length(text), 1, 0, {stop0} FROM documents WHERE regexp_matches(text, '\\S')
  UNION ALL
  SELECT doc_id, text, n, nth + 1, nxt, {stop1} FROM (SELECT *, greatest(stop - 300, pos + 1) AS nxt FROM win WHERE stop < n) w
)"""


def _stop(pos: str, n: str) -> str:
    raw = f"least({pos} + 2000, {n})"
    tail = f"reverse(substr(text, {raw} - 39, 40))"
    return (
        f"CASE WHEN {raw} >= {n} THEN {n} WHEN strpos({tail}, ' ') > 0 THEN {raw} - strpos({tail}, ' ') "
        f"WHEN strpos({tail}, chr(10)) > 0 THEN {raw} - strpos({tail}, chr(10)) ELSE {raw} END"
    )


_WINDOWS = WINDOWS_SQL.format(stop0=_stop("0", "length(text)"), stop1=_stop("nxt", "n"))
_NL = "length({0}) - length(replace({0}, chr(10), ''))"
CHUNKS_SQL = f"""
SELECT doc_id, 'chunk_' || nth AS section,
  CAST({_NL.format('substr(text, 1, pos)')} + 1 AS INTEGER) AS start_line,
  CAST({_NL.format('substr(text, 1, stop)')} + 1 AS INTEGER) AS end_line,
  substr(text, pos + 1, stop - pos) AS text
FROM win"""


@query("chunk_overlap", f"""
WITH {_WINDOWS}
SELECT doc_id, section, start_line, end_line, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest
FROM ({CHUNKS_SQL}) c""")
def chunk_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True)
    return docs.select("doc_id", F.inline(overlap_chunks("text"))).select(
        "doc_id", "section", "start_line", "end_line", F.length("text").alias("n_chars"), F.md5("text").alias("digest")
    )


CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)> \\*\\*(?:Version|Версия):[^\\n]*\\n(?:> \\|[^\\n]*\\n)*', '', 'g'),"
    " '(?s)<!-- .*? -->', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(13) || chr(9) || ' ')"
)

HEADERS_SQL = f"""
clean AS (SELECT path, {CLEAN.format('content')} AS content FROM ({inputs.MARKDOWN_SQL}) m),
lines AS (SELECT path, string_split(content, chr(10)) AS ls FROM clean),
line AS (SELECT path, ls, unnest(ls) AS l, unnest(range(len(ls))) AS ln FROM lines),
marked AS (
  SELECT *, regexp_matches(l, '^`{{3,}}') AS fence,
    sum(CASE WHEN regexp_matches(l, '^`{{3,}}') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) AS n_fence
  FROM line),
head AS (
  SELECT path, ls, ln, trim(l) AS title, length(regexp_extract(l, '^(#+)', 1)) AS level FROM marked
  WHERE regexp_matches(l, '^#{{1,3}}[ \\t]+\\S') AND NOT fence AND n_fence % 2 = 0),
trail AS (
  SELECT *, max(CASE WHEN level = 1 THEN ln END) OVER w AS ln1, max(CASE WHEN level = 2 THEN ln END) OVER w AS ln2
  FROM head WINDOW w AS (PARTITION BY path ORDER BY ln)),
split AS (
  SELECT path, ls, ln, level, title,
    CASE WHEN ln1 IS NOT NULL THEN trim(ls[ln1 + 1]) END AS h1,
    CASE WHEN level = 2 THEN title WHEN ln2 > coalesce(ln1, -1) THEN trim(ls[ln2 + 1]) END AS h2,
    lead(ln) OVER (PARTITION BY path ORDER BY ln) AS nxt
  FROM trail WHERE level > 1),
md_chunks AS (
  SELECT path, concat_ws(' > ', h1, h2, CASE WHEN level = 3 THEN title END) AS section,
    CAST(ln + 1 AS INTEGER) AS start_line, CAST(coalesce(nxt, len(ls)) AS INTEGER) AS end_line,
    concat_ws(' > ', h1, h2, CASE WHEN level = 3 THEN title END) || chr(10)
      || trim(array_to_string(ls[ln + 1: coalesce(nxt, len(ls))], chr(10)), chr(10) || ' ') AS text
  FROM split)"""


@query("chunk_headers", f"""
WITH {HEADERS_SQL}
SELECT path, section, start_line, end_line, md5(text) AS digest FROM md_chunks""")
def chunk_headers(spark, sf_dir):
    chunks = chunk_documents(clean_view(inputs.markdown(spark, sf_dir)))
    return chunks.select("path", "section", "start_line", "end_line", F.md5("text").alias("digest"))


# --- keywords --------------------------------------------------------------------------------

def _terms_oracle(source: str, key: str, text: str) -> str:
    """SQL for classed identifier terms of a text: key, term, class, ln, nth."""
    return f"""
tokens AS (SELECT {key}, raw, ln FROM (
  SELECT {key}, unnest(ws) AS raw, unnest(range(len(ws))) AS ln
  FROM (SELECT {key}, regexp_split_to_array({text}, '\\s+') AS ws FROM ({source}) s) a) b
  WHERE regexp_matches(raw, '\\p{{Nd}}') OR regexp_matches(raw, '.\\p{{Lu}}') OR regexp_matches(raw, '.[-_.:/].')),
stripped AS (SELECT {key}, ln, regexp_replace(regexp_replace(raw, '^[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+$', '') AS t FROM tokens),
facts AS (SELECT *, regexp_matches(t, '\\p{{L}}') AS letters, regexp_matches(t, '\\p{{Nd}}') AS digits,
  regexp_matches(t, '\\p{{Lu}}') AS upper_, regexp_matches(t, '(?s)^.+[-_.:/].+$') AS joined FROM stripped WHERE t <> ''),
classed AS (SELECT {key}, ln, replace(lower(t), 'ß', 'ss') AS term, CASE
  WHEN letters AND digits AND NOT joined THEN 0
  WHEN letters AND joined AND (digits OR upper_ OR regexp_matches(t, '[-_]') OR regexp_matches(t, '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}\\.[A-Za-z0-9]{{1,5}}$')) THEN 1
  WHEN regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}]') AND regexp_matches(t, '(?s)^.+\\p{{Lu}}') THEN 2
  WHEN regexp_matches(t, '^\\p{{L}}{{2,6}}$') AND upper_ AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}]')
    AND t NOT IN ('NOT', 'ALWAYS', 'NEVER', 'MUST', 'ONLY', 'ALSO') THEN 3
  WHEN digits AND NOT letters AND joined AND length(t) >= 5 THEN 4 END AS class FROM facts),
first AS (SELECT {key}, term, min(ln) AS ln, arg_min(class, ln) AS class FROM classed WHERE class IS NOT NULL GROUP BY {key}, term),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY class, ln) AS nth FROM first)"""


_IDS = """SELECT c_custkey AS id, c_name || ' of ' || c_mktsegment || ' in ' || n_name || ' region ' || r_name
  || ' holds acc-' || c_custkey || ' with F' || c_custkey || ', F' || c_custkey || ' (see docs/' || r_name || '.md) by NodeJs at '
  || c_nationkey || '.' || c_custkey || '.01 NOT NASA end.' AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query("keywords", f"""
WITH {_terms_oracle(_IDS, 'id', 'text')}
SELECT id, term, CAST(nth AS INTEGER) AS nth FROM ordered""")
def keywords(spark, sf_dir):
    customer = table(spark, sf_dir, "customer", spread=True)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    text = F.format_string(
        "%s of %s in %s region %s holds acc-%d with F%d, F%d (see docs/%s.md) by NodeJs at %d.%d.01 NOT NASA end.",
        "c_name", "c_mktsegment", "n_name", "r_name", "c_custkey", "c_custkey", "c_custkey", "r_name",
        "c_nationkey", "c_custkey",
    )
    terms = rows.select(F.col("c_custkey").alias("id"), F.posexplode(identifier_terms(text)).alias("nth", "term"))
    return terms.select("id", "term", (F.col("nth") + 1).alias("nth"))


@query("keyword_budget", f"""
WITH RECURSIVE {_terms_oracle('SELECT page_id, html FROM pages', 'page_id', 'html').strip()},
fold(page_id, nth, n, bytes, kept, dropped) AS (
  SELECT page_id, 0, 0, 0, '', 0 FROM pages
  UNION ALL
  SELECT f.page_id, f.nth + 1,
    CASE WHEN ok THEN f.n + 1 ELSE f.n END, CASE WHEN ok THEN f.bytes + cost ELSE f.bytes END,
    CASE WHEN ok THEN f.kept || CASE WHEN f.n > 0 THEN ' ' ELSE '' END || term ELSE f.kept END,
    CASE WHEN ok THEN f.dropped ELSE f.dropped + 1 END
  FROM (SELECT f.*, o.term, strlen(o.term) + CASE WHEN f.n > 0 THEN 1 ELSE 0 END AS cost,
          length(o.term) <= 64 AND f.n < 20 AND f.bytes + strlen(o.term) + CASE WHEN f.n > 0 THEN 1 ELSE 0 END <= 512 AS ok
        FROM fold f JOIN ordered o ON o.page_id = f.page_id AND o.nth = f.nth + 1) f)
SELECT page_id, arg_max(kept, nth) AS keywords, CAST(arg_max(dropped, nth) AS INTEGER) AS n_dropped FROM fold GROUP BY page_id""")
def keyword_budget(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", spread=True)
    found = pages.select("page_id", extract_keywords(F.lit(""), "html").alias("k"))
    return found.select(
        "page_id", F.array_join("k.kept", " ").alias("keywords"), F.size("k.dropped").alias("n_dropped")
    )


# --- lanes and fusion ------------------------------------------------------------------------

_BM25_SQL = f"""
WITH q AS (SELECT item_id AS qid, text AS query FROM benchmark),
c AS (SELECT doc_id, text FROM documents)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score
FROM ({inputs.bm25_sql('q', 'c', 'qid', 'query', 'doc_id', 'text', 5)}) r"""


def _bm25(spark, sf_dir, **options):
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id AS qid", "text AS query")
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    top = bm25(queries, docs, 5, keys=["doc_id"], text="text", **options)
    return top.select("qid", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("bm25_topk", _BM25_SQL)
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query("bm25_join", _BM25_SQL)
def bm25_join(spark, sf_dir):
    """Query sides whose weights are too many for one block."""
    return _bm25(spark, sf_dir, max_weights=200_000)


@query("bm25_postings", _BM25_SQL)
def bm25_from_postings(spark, sf_dir):
    """Stored postings, of which a query reads its terms' buckets and skips what can't reach its best rows."""
    root = scratch_path(spark, "postings")
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    write_postings(docs, root, ["doc_id"], "text")
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id AS qid", "text AS query")
    top = bm25_postings(queries, read_postings(spark, root), 5)
    return top.select("qid", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("bm25_statistics", f"""
WITH t AS (SELECT doc_id, {inputs.terms_sql('text')} AS ts FROM documents),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM t) u GROUP BY term)
SELECT term, df, (SELECT count(*) FROM documents) AS n_docs, (SELECT round(avg(len(ts)), 4) FROM t) AS avg_len FROM f""")
def bm25_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True)
    stats = bm25_stats(docs, "text")
    return document_frequency(docs, "text").select(
        "term", "df", stats.select("n_docs").scalar().alias("n_docs"),
        F.round(stats.select("avg_len").scalar(), 4).alias("avg_len"),
    )


_LANES = """
v AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 20),
s AS (SELECT c_nationkey, c_custkey, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(total, 2) DESC, c_custkey) AS rank FROM s QUALIFY rank <= 20)"""


@query("rrf_fused", f"""
WITH {_LANES},
j AS (SELECT coalesce(v.c_nationkey, k.c_nationkey) AS qid, coalesce(v.c_custkey, k.c_custkey) AS key,
  v.rank AS vr, k.rank AS kr, v.c_acctbal AS distance FROM v FULL JOIN k ON v.c_nationkey = k.c_nationkey AND v.c_custkey = k.c_custkey),
s2 AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + kr), 0) AS score FROM j)
SELECT qid, key, distance, round(score, 6) AS score,
  CASE WHEN vr IS NOT NULL AND kr IS NOT NULL THEN 'both' WHEN vr IS NOT NULL THEN 'vector' ELSE 'keyword' END AS match,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST, key) AS INTEGER) AS rank
FROM s2 QUALIFY rank <= 10""")
def rrf_fused(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    vector = top_k_per_key(customer, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 20)
    spent = (
        customer.join(orders, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_custkey").agg(F.sum("o_totalprice").alias("total"))
    )
    keyword = top_k_per_key(spent, ["c_nationkey"], [F.desc(F.round("total", 2)), "c_custkey"], 20)
    named = lambda df, *more: df.select(
        F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("key"), "rank", *more
    )
    fused = rrf(named(vector, F.col("c_acctbal").alias("distance")), named(keyword), 10, keys=["key"])
    return fused.select("qid", "key", "distance", F.round("score", 6).alias("score"), "match", "rank")


# --- search plans ----------------------------------------------------------------------------

_CHUNKED = f"""
chunk AS (SELECT doc_id, 'doc_' || doc_id || '.txt' AS path, section, start_line, end_line, text,
  'doc_' || doc_id || ':' || start_line || ':' || end_line AS ckey FROM ({CHUNKS_SQL}) c0),
cv AS MATERIALIZED (SELECT c.path, c.section, c.start_line, c.end_line, x.vector FROM chunk c JOIN ({inputs.hashed_sql('SELECT doc_id || section AS ck, text FROM chunk', 'ck', 'text', None)}) x ON x.ck = c.doc_id || c.section),
qv AS MATERIALIZED ({inputs.hashed_sql('SELECT item_id AS qid, text FROM benchmark', 'qid', 'text', None)})"""


def _passages(spark, sf_dir):
    """Documents, the table of their embedded chunks, and the benchmark items as queries."""
    docs = table(spark, sf_dir, "documents", spread=True).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    root = scratch_path(spark, "chunks")
    embed(chunk_documents(docs), "text", cap=None).write.parquet(root)
    chunks = spark.read.parquet(root)
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id AS qid", "text AS query")
    return docs, chunks, queries


@query("search_sections", f"""
WITH {_WINDOWS}, {_CHUNKED},
near AS ({inputs.near_sql('qv', 'cv', 'qid', 'path, start_line, end_line, section', 5)})
SELECT n.qid, CAST(n.rank AS INTEGER) AS rank, n.path, n.start_line, n.end_line, n.section, round(n.distance, 4) AS distance,
  md5(array_to_string(string_split(d.text, chr(10))[n.start_line: n.end_line], chr(10))) AS digest
FROM near n JOIN documents d ON 'doc_' || d.doc_id || '.txt' = n.path""")
def search_sections(spark, sf_dir):
    """Which passages contain or resemble each benchmark item."""
    docs, chunks, queries = _passages(spark, sf_dir)
    hits = searching.search_sections(queries, chunks, docs, 5)
    return hits.select(
        "qid", "rank", "path", "start_line", "end_line", "section",
        F.round("distance", 4).alias("distance"), F.md5("content").alias("digest"),
    )


_HYBRID_SQL = f"""
WITH {_WINDOWS}, {_CHUNKED},
kw AS (SELECT path, start_line, end_line, section, text AS keywords FROM chunk),
q AS (SELECT item_id AS qid, text AS query FROM benchmark),
v AS ({inputs.near_sql('qv', 'cv', 'qid', 'path, start_line, end_line, section', 5)}),
k AS ({inputs.bm25_sql('q', 'kw', 'qid', 'query', 'path, start_line, end_line, section', 'keywords', 5)}),
v1 AS (SELECT qid, path, start_line, end_line, sum(1.0::DOUBLE / (60 + rank)) AS part, min(rank) AS r, arg_max(section, rank) AS section, arg_max(distance, rank) AS distance FROM v GROUP BY ALL),
k1 AS (SELECT qid, path, start_line, end_line, sum(1.0::DOUBLE / (60 + rank)) AS part, min(rank) AS r, arg_min(section, rank) AS section FROM k GROUP BY ALL),
f AS (SELECT qid, path, start_line, end_line, coalesce(v1.part, 0) + coalesce(k1.part, 0) AS score, v1.r AS vr, k1.r AS kr,
  coalesce(v1.section, k1.section) AS section, coalesce(v1.distance, 0.0) AS distance
  FROM v1 FULL JOIN k1 USING (qid, path, start_line, end_line))
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST, path, start_line, end_line) AS INTEGER) AS rank,
  path, start_line, end_line, section, round(distance, 4) AS distance, round(score, 6) AS score,
  CASE WHEN vr IS NOT NULL AND kr IS NOT NULL THEN 'both' WHEN vr IS NOT NULL THEN 'vector' ELSE 'keyword' END AS match
FROM f QUALIFY rank <= 5"""


@query("hybrid_search", _HYBRID_SQL)
def hybrid_search(spark, sf_dir):
    """Vector lane and keyword lane over the chunks; the chunk's own words are its keywords."""
    _, chunks, queries = _passages(spark, sf_dir)
    lane = chunks.select("path", "start_line", "end_line", "section", F.col("text").alias("keywords"))
    found = searching.hybrid_search(queries, chunks, lane, k=5)
    return found.select(
        "qid", "rank", "path", "start_line", "end_line", "section", F.round("distance", 4).alias("distance"),
        F.round("score", 6).alias("score"), "match",
    )


@query("limited_lanes", """
WITH l AS (SELECT 0 AS lane, c_name AS path, CAST(c_nationkey AS INTEGER) AS line FROM customer UNION ALL SELECT 1, s_name, s_nationkey FROM supplier)
SELECT lane, path, line FROM l ORDER BY lane, path, line LIMIT 100""")
def limited_lanes(spark, sf_dir):
    """A hundred rows in all, the second lane only once the first is used up."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    lanes = [
        c.select(F.col("c_name").alias("path"), F.col("c_nationkey").alias("line")),
        s.select(F.col("s_name").alias("path"), F.col("s_nationkey").alias("line")),
    ]
    return limit_lanes(lanes, 100).select("lane", "path", "line")


@query("knn_scoped", _knn_oracle(_GAP, "b.label IN (a.label, a.label + 1)"))
def knn_scoped(spark, sf_dir):
    """Every vector searches below two directories: those of its label and of the next one."""
    v = _vectors(spark, sf_dir)
    folder = lambda n: F.concat(F.lit("l"), n.cast("string"))
    label = F.col("label")
    queries = v.select(F.col("vec_id").alias("qid"), "vector", F.array(folder(label), folder(label + 1)).alias("scopes"))
    corpus = v.select(
        F.col("vec_id").alias("key"), "vector", F.concat(folder(label), F.lit("/v"), F.col("vec_id").cast("string")).alias("path")
    )
    near = knn_join(queries, corpus, 5, scopes="scopes")
    return near.select("qid", "key", "rank", F.round("distance", 4).alias("distance"))


@query("embed_documents", f"""
WITH v AS ({inputs.hashed_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text')})
SELECT doc_id, CAST(len(vector) AS INTEGER) AS width, round(list_sum(list_transform(vector, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS mark FROM v""")
def embed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    marked = F.aggregate(
        F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return embed(docs, "text").select("doc_id", F.size("vector").alias("width"), F.round(marked, 4).alias("mark"))


_WEIGHT = "((i * 7 + j * 13) % 11 - 5) / 10.0::DOUBLE"


@query("encoder_batch", f"""
WITH v AS ({inputs.hashed_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text')}),
w AS (SELECT j, list({_WEIGHT} ORDER BY i) AS ws FROM range(64) a(i), range(8) b(j) GROUP BY j)
SELECT doc_id, CAST(j AS INTEGER) AS place, round(list_sum(list_transform(list_zip(vector, ws), lambda p: CAST(p[1] AS DOUBLE) * p[2])) + 0.00037, 3) AS value FROM v, w WHERE vector IS NOT NULL""")
def encoder_batch(spark, sf_dir):
    """Documents through a model in batches: a linear projection with broadcast weights, loaded once in a worker.

    Many values lie half-way between two roundings; they are moved off a little first.
    """
    i, j = np.mgrid[0:64, 0:8]
    encode = linear_model(spark, ((i * 7 + j * 13) % 11 - 5) / 10.0)
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    vectors = embed(docs, "text", encode=encode)
    return vectors.select("doc_id", F.posexplode("vector").alias("place", "value")).select(
        "doc_id", "place", F.round(F.col("value").cast("double") + 0.00037, 3).alias("value"))


@query("hydrate_hits", """
WITH h AS (SELECT doc_id AS qid, doc_id + quality AS doc, 1 + toxic AS s, 2 + quality AS e FROM labels)
SELECT qid, 'doc/' || doc AS path, CASE WHEN lang = 'en' THEN md5(array_to_string(string_split(text, chr(10))[s:e], chr(10))) END AS digest,
  CASE WHEN coalesce(lang, '') <> 'en' THEN 'Source file no longer exists at path: doc/' || doc || '.' END AS warning
FROM h LEFT JOIN documents ON doc_id = doc""")
def hydrate_hits(spark, sf_dir):
    """Hits in labelled documents or their neighbours; only English documents are still there."""
    path = lambda c: F.concat(F.lit("doc/"), c.cast("string")).alias("path")
    docs = table(spark, sf_dir, "documents", spread=True).where("lang = 'en'").select(
        path(F.col("doc_id")), F.col("text").alias("content")
    )
    hits = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("qid"), path(F.col("doc_id") + F.col("quality")),
        (F.col("toxic") + 1).alias("start_line"), (F.col("quality") + 2).alias("end_line"),
    )
    found = hydrate(hits, docs, spread=["qid"])
    return found.select("qid", "path", F.md5("content").alias("digest"), "warning")
