"""Named queries: clean-up, templates, sections, edits, reads, grep and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import inputs
from memlake.catalog.base import query, table
from memlake.catalog.search import CLEAN
from memlake.functions import markdown, text
from memlake.functions.paths import (
    canonical_path, extension, is_test, normalize_scopes, route_path, scope_error,
)
from memlake.operators import edits, reading, retrieval, versions
from memlake.plans.searching import cascade
from memlake.session import scratch_path

_MD = f"md AS ({inputs.MARKDOWN_SQL})"


@query("clean_text", f"""
WITH {_MD}
SELECT path, md5({CLEAN.format('content')}) AS digest FROM md
UNION ALL SELECT 'page/' || page_id, md5({CLEAN.format('html')}) FROM pages""")
def clean_text(spark, sf_dir):
    md = inputs.markdown(spark, sf_dir).select("path", "content")
    html = table(spark, sf_dir, "pages", spread=True).select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content")
    )
    return md.unionByName(html).select("path", F.md5(text.clean("content")).alias("digest"))


@query("sanitize_text", f"""
WITH {_MD},
a AS (SELECT path, regexp_replace(content, '(?s)<!-- .*? -->', '[note]', 'g') AS c FROM md),
b AS (SELECT path, replace(regexp_replace(c, 'Turn (\\d+)', 'Step \\1', 'g'), 'NASA', 'the') AS c FROM a),
n AS (SELECT path, c, strpos(c, chr(10) || '### Notes' || chr(10)) AS i, strpos(c, '## not a heading') - 1 AS j FROM b)
SELECT path, md5(CASE WHEN i > 0 THEN substr(c, 1, i) || substr(c, j + 1) ELSE c END) AS digest FROM n""")
def sanitize_text(spark, sf_dir):
    rules = [
        {"preset": "comments", "replace": "[note]"},
        {"regex": r"Turn (\d+)", "replace": r"Step \1"},
        {"replace_text": "NASA", "with_text": "the"},
        {"remove_section": "Notes"},
    ]
    md = inputs.markdown(spark, sf_dir)
    return md.select("path", F.md5(text.sanitize("content", rules)).alias("digest"))


@query("redact_paths", """
SELECT c_custkey AS id, regexp_replace(regexp_replace(
  replace(replace('Cannot open C:\\kb\\' || c_name || '.md or /srv/KB/' || c_mktsegment || '/x.md, see d:/tmp/' || c_nationkey || ' now', '/srv/kb', '[PROJECTS_ROOT]'), '/srv/KB', '[PROJECTS_ROOT]'),
  '[a-zA-Z]:\\\\[^"''\\s,<>|]+', '[PATH]', 'g'), '[a-zA-Z]:/', '[PATH]/', 'g') AS message FROM customer""")
def redact_paths(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    message = F.concat(
        F.lit("Cannot open C:\\kb\\"), "c_name", F.lit(".md or /srv/KB/"), "c_mktsegment",
        F.lit("/x.md, see d:/tmp/"), F.col("c_nationkey").cast("string"), F.lit(" now"),
    )
    return c.select(F.col("c_custkey").alias("id"), text.redact_paths(message, "/srv/kb").alias("message"))


@query("render_template", """
SELECT p_partkey AS id, 'Build b' || p_size || ' of ' || p_brand || ': ' || p_name || ' {{price}} 1.' || p_size || ' on 2024-01-31 {{' || p_type || '}} {{p_name}} .' AS text,
  array_to_string(list_sort(list_distinct(['price', p_type])), ',') AS unresolved FROM part""")
def render_template(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    template = F.concat(
        F.lit("Build {{build_name}} of {{Project_Name}}: {{name}} {{price}} {{VERSION}} on {{date}} {{"), "p_type",
        F.lit("}} {{other}} ."),
    )
    own = F.create_map(F.lit("name"), F.col("p_name"), F.lit("other"), F.lit("{{p_name}}"))
    size = F.col("p_size").cast("string")
    known = text.template_variables(
        F.col("p_brand"), F.concat(F.lit("b"), size), F.concat(F.lit("1."), size), F.lit("2024-01-31"), own
    )
    return part.select(
        F.col("p_partkey").alias("id"), text.render(template, known).alias("text"),
        F.array_join(text.unresolved(template, known), ",").alias("unresolved"),
    )


_TURN = "strpos(content, '## Turn ')"


@query("section_extract", f"""
WITH {_MD}
SELECT path,
  CASE WHEN role = 'system' THEN NULL ELSE md5(rtrim(substr(content, {_TURN}, strpos(content, '## not a heading') - {_TURN}), chr(10))) END AS plain,
  CASE WHEN role = 'system' THEN NULL ELSE md5(rtrim(substr(content, {_TURN}, strpos(content, '## Role ') - {_TURN}), chr(10))) END AS fenced,
  CAST(CASE WHEN role = 'system' THEN NULL ELSE 8 END AS INTEGER) AS line
FROM md""")
def section_extract(spark, sf_dir):
    """The turn's section, cut at any heading line and cut at headings outside fences."""
    md = inputs.markdown(spark, sf_dir)
    name = F.concat(F.lit("##  turn  "), F.col("turn").cast("string"))
    return md.select(
        "path", F.md5(markdown.section("content", name)).alias("plain"),
        F.md5(markdown.section("content", name, fence_aware=True)).alias("fenced"),
        markdown.section_start_line("content", name).alias("line"),
    )


@query("find_sections", f"""
WITH {_MD},
two AS (SELECT path, content || content AS content FROM md),
line AS (SELECT path, ls, unnest(ls) AS l, unnest(range(len(ls))) AS ln FROM (SELECT path, string_split(content, chr(10)) AS ls FROM two) x),
head AS (SELECT path, ln, l, len(ls) AS n, length(regexp_extract(l, '^(#+)', 1)) AS level FROM line WHERE regexp_matches(l, '^#'))
SELECT h.path, CAST(h.ln + 1 AS INTEGER) AS start_line, CAST(coalesce(min(x.ln), any_value(h.n)) AS INTEGER) AS end_line
FROM head h LEFT JOIN head x ON x.path = h.path AND x.ln > h.ln AND x.level <= h.level
WHERE h.l = '### Tail' GROUP BY h.path, h.ln""")
def find_sections(spark, sf_dir):
    md = inputs.markdown(spark, sf_dir)
    twice = F.concat("content", "content")
    found = markdown.find_sections(twice, F.lit("tail"))
    return md.select("path", F.inline(found))


@query("outline", f"""
WITH {_MD},
line AS (SELECT path, trim(unnest(ls)) AS l, unnest(range(len(ls))) AS ln FROM (SELECT path, string_split(content, chr(10)) AS ls FROM md) x)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ln) AS INTEGER) AS position, l AS heading FROM line WHERE l LIKE '#%'""")
def outline(spark, sf_dir):
    return reading.outline_rows(inputs.markdown(spark, sf_dir))


_GREP_PATTERNS = """q AS (SELECT item_id * 1000 + n AS qid, p AS query, lower(p) AS p FROM (
  SELECT item_id, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM (SELECT item_id, string_split(text, chr(10)) AS ps FROM benchmark) x) y)"""
_GREP_LINES = """
line AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x)"""


@query("grep_lines", f"""
WITH {_GREP_PATTERNS}, {_GREP_LINES},
hit AS (SELECT qid, 'doc/' || doc_id AS path, CAST(ln AS INTEGER) AS line, md5(trim(l, ' ' || chr(9) || chr(13))) AS content FROM line, q WHERE p <> '' AND contains(lower(l), p))
SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY path, line) <= 100""")
def grep_lines(spark, sf_dir):
    docs, queries = _grep_inputs(spark, sf_dir)
    found = reading.grep(docs, queries, cap=reading.GREP_CAP)
    return found.select("qid", "path", "line", F.md5("content").alias("content"))


@query("grep_large", f"""
WITH {_GREP_PATTERNS}, {_GREP_LINES}
SELECT qid, 'doc/' || doc_id AS path, CAST(ln AS INTEGER) AS line FROM line, q WHERE p <> '' AND contains(lower(l), p)""")
def grep_large(spark, sf_dir):
    """The plan for pattern tables beyond the broadcast bound."""
    docs, queries = _grep_inputs(spark, sf_dir)
    return reading.grep(docs, queries, cap=None, max_patterns=0).select("qid", "path", "line")


@query("grep_all", f"""
WITH {_GREP_PATTERNS}, {_GREP_LINES}
SELECT qid, 'doc/' || doc_id AS path, CAST(ln AS INTEGER) AS line FROM line, q WHERE p <> '' AND contains(lower(l), p)""")
def grep_all(spark, sf_dir):
    """Every line of every benchmark text, in all documents, all hits."""
    docs, asked = _grep_inputs(spark, sf_dir)
    return reading.grep(docs, asked).select("qid", "path", "line")


@query("grep_indexed", f"""
WITH {_GREP_PATTERNS}, {_GREP_LINES}
SELECT qid, 'doc/' || doc_id AS path, CAST(ln AS INTEGER) AS line FROM line, q WHERE p <> '' AND contains(lower(l), p)""")
def grep_indexed(spark, sf_dir):
    """Stored grams: only the buckets of the patterns' grams and the texts that share one are read."""
    docs, asked = _grep_inputs(spark, sf_dir)
    root = scratch_path(spark, "grams")
    reading.write_grams(docs, root)
    return reading.grep(docs, asked, index=reading.read_grams(spark, root)).select("qid", "path", "line")


def _grep_inputs(spark, sf_dir):
    """Documents, and the whole lines of the benchmark texts."""
    docs = table(spark, sf_dir, "documents", spread=True).select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "query"))
    return docs, lines.select((F.col("item_id") * 1000 + F.col("n")).alias("qid"), "query")


_SPACED = "trim(regexp_replace(substr({0}, 1, 300), '\\s+', ' ', 'g'))"


@query("cascade_search", f"""
WITH {_GREP_PATTERNS}, {_GREP_LINES},
dv AS MATERIALIZED ({inputs.hashed_sql("SELECT 'doc/' || doc_id AS path, text FROM documents", 'path', 'text')}),
qv AS MATERIALIZED ({inputs.hashed_sql("SELECT qid, query AS text FROM q", 'qid', 'text', None)}),
near AS ({inputs.near_sql('qv', 'dv', 'qid', 'path', 10)}),
both_ AS (
  SELECT n.qid, 0 AS lane, n.rank AS nth, n.path, 1 AS line, '[Semantic Match] ' || {_SPACED.format('d.text')} || '...' AS content, n.distance
  FROM near n JOIN documents d ON n.path = 'doc/' || d.doc_id
  UNION ALL SELECT qid, 1, 0, 'doc/' || doc_id, ln, trim(l, ' ' || chr(9) || chr(13)), NULL FROM line, q WHERE p <> '' AND contains(lower(l), p)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lane, nth, path, line) AS rank FROM both_)
SELECT qid, CAST(rank AS INTEGER) AS rank, lane, path, CAST(line AS INTEGER) AS line, md5(content) AS digest, round(distance, 4) AS distance FROM ranked WHERE rank <= 100""")
def cascade_search(spark, sf_dir):
    from memlake.functions.embedding import embed

    docs, queries = _grep_inputs(spark, sf_dir)
    found = cascade(queries, embed(docs, "content"), docs)
    return found.select(
        "qid", "rank", "lane", "path", "line", F.md5("content").alias("digest"),
        F.round("distance", 4).alias("distance"),
    )


@query("read_lines", """
WITH r AS (SELECT doc_id AS rid, doc_id + quality AS doc, quality + 1 AS s, 3 + toxic - 4 * toxic * quality AS e FROM labels)
SELECT rid, CASE WHEN e < s OR d.doc_id IS NULL THEN NULL ELSE md5(array_to_string(string_split(d.text, chr(10))[s:e], chr(10))) END AS digest,
  CASE WHEN e < s THEN 'start_line must be >= 1 and end_line must be >= start_line.' WHEN d.doc_id IS NULL THEN 'File not found: doc/' || doc END AS error
FROM r LEFT JOIN documents d ON d.doc_id = doc""")
def read_lines(spark, sf_dir):
    """Lines of every labelled document or its neighbour; some requests are out of order or miss."""
    docs = _grep_inputs(spark, sf_dir)[0]
    requests = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("rid"),
        F.concat(F.lit("doc/"), (F.col("doc_id") + F.col("quality")).cast("string")).alias("path"),
        (F.col("quality") + 1).alias("start_line"),
        (3 + F.col("toxic") - 4 * F.col("toxic") * F.col("quality")).alias("end_line"),
    )
    read = reading.read_lines(requests, docs)
    return read.select("rid", F.md5("content").alias("digest"), "error")


_BODY = "rtrim(content, chr(10))"
_NUM = f"array_to_string(list_transform(string_split({_BODY}, chr(10)), lambda x, i: i || ': ' || x), chr(10))"
_SKIP = f"greatest(0, length({_BODY}) + 1 - 5 - 60)"


@query("read_docs", f"""
WITH {_MD}
SELECT path, CASE role
  WHEN 'user' THEN md5(CASE WHEN length({_NUM}) - 7 >= 120 THEN '[Text truncated: 7 characters skipped at the beginning]' || chr(10) || '... ' || substr({_NUM}, 8, 120) || chr(10) || '... [Text truncated: limit 120 characters exceeded]'
    ELSE '[Text truncated: 7 characters skipped at the beginning]' || chr(10) || '... ' || substr({_NUM}, 8) END)
  WHEN 'assistant' THEN md5(CASE WHEN {_SKIP} > 0 THEN '[Text truncated: ' || {_SKIP} || ' characters skipped at the beginning]' || chr(10) || '... ' ELSE '' END
    || substr({_BODY}, {_SKIP} + 1, 60) || CASE WHEN length({_BODY}) - {_SKIP} >= 60 THEN chr(10) || '... [Text truncated: limit 60 characters exceeded]' ELSE '' END)
  ELSE NULL END AS digest,
  CASE WHEN role NOT IN ('user', 'assistant') THEN 'Section ''Turn'' not found in ' || path || '.' END AS error
FROM md""")
def read_docs(spark, sf_dir):
    """One request per document: numbered pages, pages from the end, and a section that is not there."""
    md = inputs.markdown(spark, sf_dir)
    user, helper = F.col("role") == "user", F.col("role") == "assistant"
    requests = md.select(
        F.col("path").alias("rid"), "path",
        F.when(user | helper, "paged").otherwise("section").alias("mode"),
        F.when(user, 120).otherwise(60).alias("max_chars"),
        F.when(user, 7).otherwise(5).alias("skip_chars"),
        user.alias("line_numbers"),
        F.when(helper, "end").otherwise("begin").alias("direction"),
        F.lit("Turn").alias("section_name"),
    )
    read = reading.read_docs(requests, md.select("path", "content"))
    return read.select("path", F.md5("text").alias("digest"), "error")


@query("list_docs", f"""
WITH p AS (SELECT DISTINCT string_split(path, '/') AS s FROM ({inputs.PAGES_SQL}) x),
e AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p WHERE NOT list_bool_or(list_transform(s, lambda x: x LIKE '.%')))
SELECT DISTINCT array_to_string(s[1:n], '/') || CASE WHEN n < len(s) THEN '/' ELSE '' END AS name,
  CASE WHEN n < len(s) THEN 'dir' ELSE 'file' END AS type FROM e""")
def list_docs(spark, sf_dir):
    return reading.list_docs(inputs.pages(spark, sf_dir), recursive=True)


@query("scope_filter", f"""
WITH p AS ({inputs.PAGES_SQL}), s AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS scope FROM p WHERE url LIKE 'https:%')
SELECT page_id, path FROM p WHERE EXISTS (SELECT 1 FROM s WHERE starts_with(p.path, s.scope || '/'))""")
def scope_filter(spark, sf_dir):
    """Pages below any directory that holds a page served over https."""
    pages = inputs.pages(spark, sf_dir)
    scopes = pages.where(F.col("url").startswith("https:")).select(F.regexp_replace("path", "/[^/]*$", "").alias("scope"))
    return retrieval.scope_filter(pages.select("page_id", "path"), scopes)


_SCOPES = "CASE WHEN url LIKE '%#%' THEN [path || '/', '/' || path] WHEN url LIKE '%?%' THEN [' ' || replace(path, '/', chr(92)) || '// ', 'a/../b'] WHEN url LIKE 'https%' THEN [path, '  '] ELSE [path || '/x/'] END"


@query("scope_rules", f"""
WITH p AS (SELECT page_id, list_transform({_SCOPES}, lambda x: regexp_replace(replace(trim(x), chr(92), '/'), '/+$', '')) AS s FROM ({inputs.PAGES_SQL}) x)
SELECT page_id, array_to_string(s, ',') AS scopes,
  CASE WHEN list_contains(s, '') THEN 'Scope must not be empty.'
    WHEN len(list_filter(s, lambda x: x LIKE '/%' OR regexp_matches(x, '(^|/)\\.\\.(/|$)'))) > 0
    THEN 'Invalid scope: ''' || list_filter(s, lambda x: x LIKE '/%' OR regexp_matches(x, '(^|/)\\.\\.(/|$)'))[1] || '''. Scopes must be directories inside the project''s artifacts folder.' END AS reason
FROM p""")
def scope_rules(spark, sf_dir):
    pages, url, path = inputs.pages(spark, sf_dir), F.col("url"), F.col("path")
    given = (
        F.when(url.contains("#"), F.array(F.concat(path, F.lit("/")), F.concat(F.lit("/"), path)))
        .when(url.contains("?"), F.array(F.concat(F.lit(" "), F.replace(path, F.lit("/"), F.lit("\\")), F.lit("// ")), F.lit("a/../b")))
        .when(url.startswith("https"), F.array(path, F.lit("  ")))
        .otherwise(F.array(F.concat(path, F.lit("/x/"))))
    )
    clean = pages.select("page_id", normalize_scopes(given).alias("s"))
    return clean.select("page_id", F.array_join("s", ",").alias("scopes"), scope_error("s").alias("reason"))


@query("empty_scopes", f"""
WITH p AS ({inputs.PAGES_SQL})
SELECT q.page_id AS qid, 'No artifacts found under scopes: ' || regexp_replace(q.path, '[^/]+$', 'none') || '. Scopes are directories.' AS message FROM p q
WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(p.path, regexp_replace(q.path, '[^/]+$', 'none') || '/')) AND q.url LIKE '%?%'""")
def empty_scopes(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    none = F.array(F.regexp_replace("path", "[^/]+$", "none"))
    unscoped = F.array().cast("array<string>")
    queries = pages.select(F.col("page_id").alias("qid"), F.when(F.col("url").contains("?"), none).otherwise(unscoped).alias("scopes"))
    asked = queries.select("qid", F.explode("scopes").alias("dir"))
    above = pages.select(F.explode(retrieval.ancestors("path")).alias("dir")).distinct()
    hits = asked.join(above, "dir", "left_semi")
    return retrieval.empty_scopes(queries, hits)


@query("path_functions", f"""
WITH p AS ({inputs.PAGES_SQL})
SELECT page_id, lower(path) AS canonical, lower(regexp_extract(path, '[^./](\\.[^./]*)$', 1)) AS ext,
  regexp_matches(lower(path), 'tests/|test_') AS is_test, 'done/2024/k' || page_id || '.md' AS routed FROM p""")
def path_functions(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    key = F.concat(F.lit("k"), F.col("page_id").cast("string"))
    return pages.select(
        "page_id", canonical_path(F.concat(F.lit("./"), F.col("path"))).alias("canonical"),
        extension("path").alias("ext"), is_test("path").alias("is_test"),
        route_path(key, F.lit("Closed"), F.lit(2024)).alias("routed"),
    )


# --- edits -----------------------------------------------------------------------------------

_EDITS = f"""
e AS (
  SELECT path, 1 AS seq, 'patch' AS mode FROM md UNION ALL SELECT path, 2, 'replace_chunk' FROM md
  UNION ALL SELECT path, 3, 'replace_chunk' FROM md UNION ALL SELECT path, 4, 'delete_section' FROM md
  UNION ALL SELECT path, 5, 'append_section' FROM md UNION ALL SELECT path, 6, 'bogus' FROM md)"""


def edit_rows(spark, sf_dir):
    """Six edits per document: a patch, two line replacements, a section dropped, one added, one unknown."""
    md = inputs.markdown(spark, sf_dir)
    row = lambda seq, mode, **kw: F.struct(
        F.lit(seq).alias("seq"), F.lit(mode).alias("mode"),
        *[(kw[c] if c in kw else F.lit(None)).cast(t).alias(c) for c, t in edits.EDIT_FIELDS.items()],
    )
    steps = F.array(
        row(1, "patch", old_str=F.lit("The NASA memo"), content=F.concat(F.lit("A memo of "), F.col("role"))),
        row(2, "replace_chunk", start_line=F.lit(1), content=F.lit("# New title")),
        row(3, "replace_chunk", start_line=F.lit(4), end_line=F.lit(5), content=F.lit("Opened.")),
        row(4, "delete_section", section_name=F.lit("Notes")),
        row(5, "append_section", section_name=F.lit("## Extra"), content=F.lit("More.")),
        row(6, "bogus", content=F.lit("x")),
    )
    return md.select("path", F.inline(steps)), md.select("path", "content")


# Lines 1 and 4-5 replaced, then the patch, then the first section of that name dropped.
_EDITED = """
s1 AS (SELECT path, role, string_split(rtrim(content, chr(10)), chr(10)) AS ls FROM md),
s2 AS (SELECT path, role, '# New title' || chr(10) || array_to_string(ls[2:3], chr(10)) || chr(10) || 'Opened.' || chr(10) || array_to_string(ls[6:], chr(10)) || chr(10) AS c FROM s1),
s3 AS (SELECT path, role, replace(c, 'The NASA memo', 'A memo of ' || role) AS c FROM s2),
s4 AS (SELECT path, role, c, strpos(c, '### Notes') AS i, strpos(c, '## not a heading') AS j FROM s3),
s5 AS (SELECT path, role, CASE WHEN i > 0 THEN trim(rtrim(substr(c, 1, i - 1), chr(10) || ' ') || chr(10) || chr(10) || substr(c, j), chr(10) || ' ') || chr(10) ELSE c END AS c FROM s4),
s6 AS (SELECT path, role, rtrim(c, chr(10) || ' ') || chr(10) || chr(10) || '## Extra' || chr(10) || 'More.' || chr(10) AS c FROM s5)"""


@query("edit_batch", f"""
WITH {_MD}, {_EDITED} SELECT path, md5(c) AS digest FROM s6""")
def edit_batch(spark, sf_dir):
    batch, docs = edit_rows(spark, sf_dir)
    result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    return result.docs.select("path", F.md5("content").alias("digest"))


@query("edit_rounds", f"""
WITH {_MD}, {_EDITED} SELECT path, md5(c) AS digest FROM s6""")
def edit_rounds(spark, sf_dir):
    """The plan for documents with very many edits: at most two per round."""
    batch, docs = edit_rows(spark, sf_dir)
    result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)), per_round=2)
    return result.docs.select("path", F.md5("content").alias("digest"))


@query("edit_results", f"""
WITH {_MD}, {_EDITS}
SELECT e.path, CAST(seq AS BIGINT) AS seq, CASE WHEN seq = 6 OR (seq = 4 AND role = 'system') THEN 'error' ELSE 'success' END AS status,
  CASE WHEN seq = 6 THEN 'Unknown write mode: bogus' WHEN seq = 4 AND role = 'system' THEN 'Section ''Notes'' not found.'
    ELSE 'Applied ' || mode || ' to memory successfully. File saved.' END AS message
FROM e JOIN md USING (path)""")
def edit_results(spark, sf_dir):
    batch, docs = edit_rows(spark, sf_dir)
    result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    return result.results.select("path", "seq", "status", "message")


@query("edit_order", f"""
WITH {_MD}, {_EDITS}
SELECT path, CAST(seq AS INTEGER) AS seq, CAST(CASE seq WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE seq END AS BIGINT) AS position FROM e""")
def edit_order(spark, sf_dir):
    batch, _ = edit_rows(spark, sf_dir)
    return edits.order_edits(batch).select("path", "seq", "position")


@query("edit_snapshot", f"""
WITH {_MD} SELECT path, md5(content) AS digest, CAST(0 AS BIGINT) AS at_us FROM md""")
def edit_snapshot(spark, sf_dir):
    batch, docs = edit_rows(spark, sf_dir)
    result = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    return result.versions.select("path", F.md5("content").alias("digest"), F.unix_micros("version_ts").alias("at_us"))
