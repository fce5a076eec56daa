"""Inputs that the named queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.catalog.base import table

# --- Markdown documents: one per conversation turn ------------------------------------------

MARKDOWN_SQL = """
SELECT 'kb/conv_' || conv_id || '/turn_' || turn || '.md' AS path, conv_id, turn, role,
  '# Conversation ' || conv_id || chr(10)
  || '> **Version: ' || turn || '**' || chr(10) || '> | ' || role || ' | draft |' || chr(10)
  || 'Opening by ' || role || '.' || chr(10) || chr(10) || chr(10) || chr(10)
  || CASE WHEN role = 'system' THEN '' ELSE
     '## Turn ' || turn || chr(10) || text || chr(10)
     || '### Notes' || chr(10) || '```' || chr(10) || '## not a heading' || chr(10) || '```' || chr(10)
     || 'See F' || conv_id || ', TD-' || turn || ' and docs/conv_' || conv_id || '.md <!-- hidden ' || role || ' --> now' || chr(10)
     || '## Role ' || role || chr(10) || 'next_agent_role: ' || role || chr(10)
     END
  || '### Tail' || chr(10) || 'The NASA memo by ' || role || ' ends' || chr(10) AS content
FROM conversations
"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations", spread=True)
    return conv.select(
        F.format_string("kb/conv_%d/turn_%d.md", "conv_id", "turn").alias("path"), "conv_id", "turn", "role",
        F.concat(
            F.format_string("# Conversation %d\n> **Version: %d**\n> | %s | draft |\nOpening by %s.\n\n\n\n",
                            "conv_id", "turn", "role", "role"),
            F.when(F.col("role") == "system", "").otherwise(
                F.concat(
                    F.format_string("## Turn %d\n", "turn"), F.col("text"),
                    F.format_string(
                        "\n### Notes\n```\n## not a heading\n```\nSee F%d, TD-%d and docs/conv_%d.md"
                        " <!-- hidden %s --> now\n## Role %s\nnext_agent_role: %s\n",
                        "conv_id", "turn", "conv_id", "role", "role", "role",
                    ),
                )
            ),
            F.format_string("### Tail\nThe NASA memo by %s ends\n", "role"),
        ).alias("content"),
    )


# --- backlog: orders as tasks ----------------------------------------------------------------

TASKS_SQL = """
SELECT o_orderkey AS id,
  CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 100000 THEN 'B' ELSE 'TD' END || o_orderkey AS key,
  'Order ' || o_orderpriority || ' of customer ' || o_custkey || ' at ' || o_orderkey AS title,
  CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 100000 THEN 'B' ELSE 'TD' END AS type,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'paused' ELSE 'closed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
       WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  'market_' || (o_custkey % 5) AS project,
  CASE o_orderstatus WHEN 'O' THEN 'active/' WHEN 'P' THEN 'paused/'
       ELSE 'done/' || year(o_orderdate) || '/' END || o_orderkey || '.md' AS file_path,
  'Customer ' || o_custkey || ' waits since ' || strftime(o_orderdate, '%Y-%m-%d') AS problem,
  epoch_us(o_orderdate) AS updated_us, o_custkey AS cust, o_orderdate
FROM orders
"""


def tasks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders", spread)
    price = F.col("o_totalprice")
    kind = F.when(price > 250000, "F").when(price > 100000, "B").otherwise("TD")
    state = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(kind, F.col("o_orderkey").cast("string")).alias("key"),
        F.format_string("Order %s of customer %d at %d", "o_orderpriority", "o_custkey", "o_orderkey").alias("title"),
        kind.alias("type"),
        F.when(state == "O", "open").when(state == "P", "paused").otherwise("closed").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low").alias("priority"),
        F.concat(F.lit("market_"), (F.col("o_custkey") % 5).cast("string")).alias("project"),
        F.concat(
            F.when(state == "O", "active/").when(state == "P", "paused/")
            .otherwise(F.concat(F.lit("done/"), F.year("o_orderdate").cast("string"), F.lit("/"))),
            F.col("o_orderkey").cast("string"), F.lit(".md"),
        ).alias("file_path"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" waits since "),
                 F.date_format("o_orderdate", "yyyy-MM-dd")).alias("problem"),
        F.lit("Ship it").alias("solution"),
        F.lit(None).cast("string").alias("comments"),
        F.lit(None).cast("string").alias("resolution"),
        F.col("o_orderdate").cast("timestamp").alias("updated"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderdate").alias("o_orderdate"),
    )


# --- code units: lineitem rows as units of an order's file -----------------------------------

UNITS_SQL = """
SELECT 'supp_' || (l_suppkey % 3) AS project,
  CASE WHEN l_suppkey % 7 = 0 THEN 'tests/' ELSE 'src/' END || 'mod_' || (l_orderkey % 50) || '/order_' || l_orderkey || '.py' AS path,
  CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'method' ELSE
    CASE l_linestatus WHEN 'F' THEN 'file' ELSE 'imports' END END AS chunk_type,
  'part_' || (l_partkey % 10) AS chunk_name,
  'def part_' || l_partkey || '(): qty ' || CAST(l_quantity AS BIGINT) AS skeleton_text,
  l_linenumber * 10 AS start_line, l_linenumber * 10 + 5 AS end_line,
  l_suppkey % 7 = 0 AS is_test,
  l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
FROM lineitem
"""


def units(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", spread)
    text = lambda c: F.col(c).cast("string")
    test = F.col("l_suppkey") % 7 == 0
    return li.select(
        F.concat(F.lit("supp_"), (F.col("l_suppkey") % 3).cast("string")).alias("project"),
        F.concat(
            F.when(test, "tests/").otherwise("src/"), F.lit("mod_"), (F.col("l_orderkey") % 50).cast("string"),
            F.lit("/order_"), text("l_orderkey"), F.lit(".py"),
        ).alias("path"),
        F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "method")
        .when(F.col("l_linestatus") == "F", "file").otherwise("imports").alias("chunk_type"),
        F.concat(F.lit("part_"), (F.col("l_partkey") % 10).cast("string")).alias("chunk_name"),
        F.concat(F.lit("def part_"), text("l_partkey"), F.lit("(): qty "), F.col("l_quantity").cast("long").cast("string")).alias("skeleton_text"),
        (F.col("l_linenumber") * 10).alias("start_line"),
        (F.col("l_linenumber") * 10 + 5).alias("end_line"),
        test.alias("is_test"),
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
    )


# --- paths of web pages ----------------------------------------------------------------------

PAGES_SQL = """
SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, url, html FROM pages
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return p.select("page_id", path.alias("path"), "url", "html")


# --- versions: events as versions of a user's document ---------------------------------------

VERSIONS_SQL = """
SELECT 'notes/user_' || user_id || '.md' AS path, ts AS version_ts, event_id,
  event_type || ' ' || props || ' of ' || event_id AS content
FROM events
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("notes/user_"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("ts").cast("timestamp").alias("version_ts"),
        "event_id",
        F.concat(F.col("event_type"), F.lit(" "), F.col("props"), F.lit(" of "), F.col("event_id").cast("string")).alias("content"),
    )


# --- hashed vectors in SQL -------------------------------------------------------------------

def hashed_sql(source: str, key: str, text: str, cap: int | None = None, dim: int = 64) -> str:
    """SQL for the unit-length hashed word vectors of a text: key, vector (FLOAT list)."""
    body = f"substr({text}, 1, {cap})" if cap else text
    return f"""
    SELECT {key}, list(CAST(n / len2 AS FLOAT) ORDER BY b) AS vector FROM (
      SELECT {key}, b, n, sqrt(sum(n * n) OVER (PARTITION BY {key})) AS len2 FROM (
        SELECT k.{key}, g.b, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
        FROM (SELECT DISTINCT {key} FROM ({source}) s0 WHERE regexp_matches({body}, '[^\\s]')) k
        CROSS JOIN (SELECT unnest(range({dim})) AS b) g
        LEFT JOIN (
          SELECT {key}, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % {dim} AS b, count(*) AS n
          FROM (SELECT {key}, unnest(string_split(lower(trim(regexp_replace({body}, '\\s+', ' ', 'g'))), ' ')) AS w
                FROM ({source}) s1) t1
          GROUP BY 1, 2
        ) c ON c.{key} = k.{key} AND c.b = g.b
      ) t2
    ) t3 GROUP BY {key}
    """


def near_sql(queries: str, corpus: str, qid: str, keys: str, k: int, where: str = "true") -> str:
    """SQL for the k nearest rows: CTE names of queries (qid, vector) and corpus (keys, vector)."""
    q = ", ".join(f"c.{x.strip()}" for x in keys.split(","))
    return f"""
    SELECT {qid}, {keys}, rank, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY round(distance, 9), {keys}) AS rank FROM (
        SELECT q.{qid}, {q},
          list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS distance
        FROM {queries} q, {corpus} c WHERE {where}
      ) d
    ) r WHERE rank <= {k}
    """


def terms_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(queries: str, corpus: str, qid: str, query: str, keys: str, text: str, k: int) -> str:
    """SQL for BM25 top-k: CTE names of queries (qid, query) and corpus (keys, text)."""
    return f"""
    WITH bags AS MATERIALIZED (SELECT {keys}, {terms_sql(text)} AS bag FROM {corpus}),
    asked AS MATERIALIZED (SELECT {qid}, unnest(list_distinct({terms_sql(query)})) AS term FROM {queries}),
    terms AS MATERIALIZED (SELECT {keys}, dl, term, count(*) AS tf
      FROM (SELECT {keys}, len(bag) AS dl, unnest(bag) AS term FROM bags) b0 GROUP BY {keys}, dl, term),
    held AS MATERIALIZED (SELECT * FROM terms WHERE term IN (SELECT term FROM asked)),
    freq AS MATERIALIZED (SELECT term, ln(1.0 + ((SELECT count(*) FROM bags) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM held GROUP BY term),
    mean AS MATERIALIZED (SELECT avg(len(bag)) AS avg_len FROM bags),
    scores AS MATERIALIZED (SELECT {qid}, {keys}, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS score
      FROM held JOIN freq USING (term) JOIN asked USING (term) CROSS JOIN mean GROUP BY {qid}, {keys})
    SELECT {qid}, {keys}, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY round(score, 9) DESC, {keys}) AS rank FROM scores) r
    WHERE rank <= {k}
    """
