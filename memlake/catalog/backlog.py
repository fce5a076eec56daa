"""Named queries: backlog search, rules, ids, titles, updates, unblocking and task documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import inputs
from memlake.catalog.base import query, table
from memlake.functions import rules
from memlake.functions.text import key_number
from memlake.operators import backlog
from memlake.plans.searching import search_tasks_semantic
from memlake.sources.tasks import etl_legacy_tasks, read_task_docs, task_documents

_T = f"t AS ({inputs.TASKS_SQL})"
_NOW = "2024-06-01 00:00:00"
_NOW_US = 1717200000000000


def _now():
    return F.lit(_NOW).cast("timestamp")


@query("task_search", f"""
WITH {_T} SELECT key AS id, title, status, priority, project FROM t WHERE status = 'open' AND priority = 'high' AND type = 'F' AND project = 'market_1'""")
def task_search(spark, sf_dir):
    found = backlog.search_tasks(
        inputs.tasks(spark, sf_dir), priority="high", type_="F", project="market_1"
    )
    return found


@query("task_search_default", f"WITH {_T} SELECT key AS id, title, status, priority, project FROM t WHERE status = 'open'")
def task_search_default(spark, sf_dir):
    return backlog.search_tasks(inputs.tasks(spark, sf_dir))


@query("task_lookup", f"WITH {_T} SELECT id, key, title, status FROM t WHERE key = 'F' || 11 OR id = 7")
def task_lookup(spark, sf_dir):
    tasks = inputs.tasks(spark, sf_dir)
    both = backlog.get_task(tasks, id=7).unionByName(backlog.get_task(tasks, key="F11"))
    return both.select("id", "key", "title", "status").distinct()


@query("task_details", f"""
WITH {_T}, asked AS (SELECT key FROM t UNION SELECT 'X' || c_custkey FROM customer)
SELECT a.key, t.title, t.status, CASE WHEN t.key IS NULL OR t.status = 'paused' THEN NULL ELSE t.problem END AS problem,
  CASE WHEN t.key IS NULL THEN 'Task ''' || a.key || ''' not found'
       WHEN t.status = 'paused' THEN 'Index points to a missing document: ' || t.file_path END AS error
FROM asked a LEFT JOIN t USING (key)""")
def task_details(spark, sf_dir):
    """All tasks and as many unknown keys as customers; bodies of paused tasks are gone."""
    tasks = inputs.tasks(spark, sf_dir)
    unknown = table(spark, sf_dir, "customer").select(F.concat(F.lit("X"), F.col("c_custkey").cast("string")).alias("key"))
    bodies = tasks.where("status <> 'paused'").select("file_path", "problem")
    found = backlog.task_details(tasks.select("key").unionByName(unknown), tasks, bodies)
    return found.select("key", "title", "status", "problem", "error")


@query("assign_ids", f"""
WITH {_T}, n AS (SELECT c_custkey AS seq, CASE WHEN c_acctbal > 5000 THEN 'F' ELSE 'TD' END AS type FROM customer),
m AS (SELECT seq, type, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY seq) AS id FROM n)
SELECT seq, id, type || id AS key FROM m""")
def assign_ids(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.when(F.col("c_acctbal") > 5000, "F").otherwise("TD").alias("type")
    )
    return backlog.assign_ids(new, inputs.tasks(spark, sf_dir)).select("seq", "id", "key")


@query("next_id", f"WITH {_T} SELECT max(id) + 1 AS next_id FROM t")
def next_id(spark, sf_dir):
    return backlog.next_id(inputs.tasks(spark, sf_dir))


@query("title_unique", f"""
WITH t AS (SELECT DISTINCT 'market ' || (o_custkey % 5) || ' ' || lower(o_orderpriority) AS title FROM orders),
n AS (SELECT l_orderkey * 10 + l_linenumber AS seq, '  Market ' || (l_suppkey % 7) || ' ' || CASE WHEN l_quantity < 25 THEN '1-URGENT' ELSE '9-' || l_returnflag END AS title FROM lineitem),
f AS (SELECT lower(trim(title)) AS k, min(seq) AS first FROM n GROUP BY 1)
SELECT n.seq, CASE WHEN t.title IS NOT NULL OR n.seq > f.first THEN 'Task with title ''' || n.title || ''' already exists.' END AS reason
FROM n JOIN f ON f.k = lower(trim(n.title)) LEFT JOIN t ON t.title = f.k""")
def title_unique(spark, sf_dir):
    """Many rows share few titles: only the first of a free title passes."""
    old = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("market "), (F.col("o_custkey") % 5).cast("string"), F.lit(" "), F.lower("o_orderpriority")).alias("title")
    ).distinct()
    new = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(
            F.lit("  Market "), (F.col("l_suppkey") % 7).cast("string"), F.lit(" "),
            F.when(F.col("l_quantity") < 25, "1-URGENT").otherwise(F.concat(F.lit("9-"), "l_returnflag")),
        ).alias("title"),
    )
    return backlog.check_unique_title(new, old).select("seq", "reason")


@query("new_task_rules", """
SELECT o_orderkey AS seq, CASE
  WHEN o_orderpriority = '5-LOW' THEN 'title: Field cannot be empty'
  WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'solution: Field cannot be empty'
  WHEN o_totalprice < 50000 THEN 'type: unknown value'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'priority: unknown value' END AS reason FROM orders""")
def new_task_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "5-LOW", "  \n").otherwise("Title").alias("title"),
        F.lit("Problem").alias("problem"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000), "").otherwise("Do").alias("solution"),
        F.when(F.col("o_totalprice") < 50000, "Q").otherwise("F").alias("type"),
        F.lit(None).cast("string").alias("status"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "none").otherwise("high").alias("priority"),
    )
    return rows.select("seq", rules.new_task_reason().alias("reason"))


@query("add_tasks", """
WITH n AS (SELECT o_orderkey AS seq, trim(CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE ' Order of ' || o_custkey || ' ' END) AS title,
  CASE WHEN o_totalprice < 50000 THEN 'Q' ELSE 'B' END AS type FROM orders),
ok AS (SELECT * FROM n WHERE title <> '' AND type <> 'Q'),
f AS (SELECT min(seq) AS seq FROM ok GROUP BY lower(title)),
i AS (SELECT seq, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY seq) AS id FROM f)
SELECT n.seq, i.id, 'B' || i.id AS key, CASE WHEN n.title = '' THEN 'title: Field cannot be empty' WHEN n.type = 'Q' THEN 'type: unknown value'
  WHEN i.id IS NULL THEN 'Task with title ''' || n.title || ''' already exists.' END AS reason
FROM n LEFT JOIN i USING (seq)""")
def add_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    existing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    new = o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(
            F.concat(F.lit(" Order of "), F.col("o_custkey").cast("string"), F.lit(" "))
        ).alias("title"),
        F.lit("p").alias("problem"), F.lit("s").alias("solution"),
        F.when(F.col("o_totalprice") < 50000, "Q").otherwise("B").alias("type"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("priority"),
    )
    accepted, rejected = backlog.add_tasks(new, existing, "kb", _now())
    good = accepted.select("seq", "id", "key", F.lit(None).cast("string").alias("reason"))
    bad = rejected.select("seq", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("key"), "reason")
    return good.unionByName(bad)


_MOVES = """
m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'paused' ELSE 'closed' END AS old_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'closed' WHEN '2-HIGH' THEN 'analysis' WHEN '3-MEDIUM' THEN 'paused' WHEN '5-LOW' THEN 'OPEN' END AS new_status,
  CASE WHEN o_totalprice > 200000 THEN '  fixed ' ELSE ' ok ' END AS resolution FROM orders)"""


def _moves(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(state == "O", "Open").when(state == "P", "paused").otherwise("closed").alias("old_status"),
        F.when(prio == "1-URGENT", "closed").when(prio == "2-HIGH", "analysis").when(prio == "3-MEDIUM", "paused")
        .when(prio == "5-LOW", "OPEN").alias("new_status"),
        F.when(F.col("o_totalprice") > 200000, "  fixed ").otherwise(" ok ").alias("resolution"),
    )


@query("status_change_rule", f"""
WITH {_MOVES}
SELECT id, CASE WHEN new_status IS NOT NULL AND lower(old_status) <> lower(new_status) AND length(trim(resolution)) < 5
  THEN 'Field ''resolution'' (min 5 chars) required when changing status from ''' || lower(old_status) || ''' to ''' || lower(new_status) || '''.' END AS reason FROM m""")
def status_change_rule(spark, sf_dir):
    return _moves(spark, sf_dir).select(
        "id", rules.resolution_reason("old_status", "new_status", "resolution").alias("reason")
    )


@query("transition_rule", f"""
WITH {_MOVES}
SELECT id, CASE WHEN (lower(old_status) = 'paused' AND lower(new_status) NOT IN ('open', 'closed', 'paused'))
    OR (lower(old_status) = 'closed' AND lower(new_status) <> 'closed')
    OR (lower(old_status) = 'open' AND lower(new_status) NOT IN ('open', 'paused', 'closed', 'analysis', 'blocked'))
  THEN 'Invalid transition from ''' || lower(old_status) || ''' to ''' || lower(new_status) || '''' END AS reason FROM m""")
def transition_rule(spark, sf_dir):
    checked = rules.check_transitions(_moves(spark, sf_dir), rules.transitions_table(spark))
    return checked.select("id", "reason")


@query("edit_rules", """
WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'memory/decisions.md' WHEN 'N' THEN '../up.md' ELSE 'docs/' || l_orderkey || '.md' END AS path,
  CASE WHEN l_linenumber = 1 THEN 'append_section' WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN 'patch' ELSE 'rewrite' END AS mode FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN mode = '' THEN 'Missing ''path'' or ''mode'''
  WHEN path = 'memory/decisions.md' AND mode <> 'append_section' THEN 'Domain protection: ' || mode || ' on memory/decisions.md is forbidden. ONLY append_section is permitted.'
  WHEN path LIKE '../%' THEN 'Invalid artifact path: ' || path WHEN mode = 'rewrite' THEN 'Unknown write mode: rewrite' END AS reason,
  CASE WHEN mode = 'append_section' THEN 'Field(s) ''old_str'' are not used by write mode ''append_section'' and were ignored.'
    WHEN mode = 'patch' THEN 'Field(s) ''section_name'' are not used by write mode ''patch'' and were ignored.'
    ELSE 'Field(s) ''content'', ''old_str'', ''section_name'' are not used by write mode ''' || mode || ''' and were ignored.' END AS warning FROM e""")
def edit_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    nth, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = li.select(
        "l_orderkey", "l_linenumber",
        F.when(flag == "A", "memory/decisions.md").when(flag == "N", "../up.md")
        .otherwise(F.concat(F.lit("docs/"), F.col("l_orderkey").cast("string"), F.lit(".md"))).alias("path"),
        F.when(nth == 1, "append_section").when(nth == 2, "").when(nth == 3, "patch").otherwise("rewrite").alias("mode"),
    )
    supplied = F.array(*map(F.lit, ["path", "mode", "section_name", "content", "old_str"]))
    return rows.select(
        "l_orderkey", "l_linenumber", rules.edit_reason().alias("reason"),
        rules.unknown_fields_warning("mode", supplied).alias("warning"),
    )


# Orders wait for all earlier orders of their customer.
_BLOCKED = f"""
{_T}, links AS (SELECT b.key, a.key AS blocker, a.id AS nth FROM t a JOIN t b ON a.cust = b.cust AND a.id < b.id)"""


def _blocked(spark, sf_dir):
    """Tasks with ``blocked_by``: the earlier tasks of the same customer, in id order."""
    t = inputs.tasks(spark, sf_dir)
    own = t.alias("b").join(t.select("cust", F.col("id").alias("aid"), F.col("key").alias("akey")).alias("a"), "cust").where("aid < b.id")
    lists = own.groupBy("b.key").agg(F.array_sort(F.collect_list(F.struct("aid", "akey"))).alias("l"))
    listed = t.join(lists, "key", "left")
    none = F.array().cast("array<string>")
    return listed.withColumn("blocked_by", F.coalesce(F.transform("l", lambda x: x["akey"]), none)).drop("l")


@query("unblock", f"""
WITH {_BLOCKED},
done AS (SELECT key FROM t WHERE status = 'closed')
SELECT l.key, coalesce(string_agg(CASE WHEN d.key IS NULL THEN l.blocker END, ',' ORDER BY l.nth), '') AS blocked_by, count(d.key) AS n_removed
FROM links l JOIN t ON t.key = l.key AND t.status = 'open' LEFT JOIN done d ON d.key = l.blocker GROUP BY l.key HAVING count(d.key) > 0""")
def unblock(spark, sf_dir):
    tasks = _blocked(spark, sf_dir)
    freed = backlog.unblock(tasks, tasks.where("status = 'closed'"))
    return freed.select("key", F.array_join("blocked_by", ",").alias("blocked_by"), "n_removed")


@query("complete_tasks", f"""
WITH {_BLOCKED},
hit AS (SELECT key FROM t WHERE status = 'open' AND priority = 'critical'),
rest AS (SELECT l.key, string_agg(CASE WHEN h.key IS NULL THEN l.blocker END, ',' ORDER BY l.nth) AS b, count(h.key) AS n
  FROM links l LEFT JOIN hit h ON h.key = l.blocker GROUP BY l.key)
SELECT t.key, CASE WHEN h.key IS NOT NULL THEN 'closed' ELSE t.status END AS status, CASE WHEN h.key IS NOT NULL THEN 'shipped' END AS resolution,
  md5(coalesce(CASE WHEN t.status = 'open' AND h.key IS NULL THEN r.b ELSE (SELECT string_agg(blocker, ',' ORDER BY nth) FROM links x WHERE x.key = t.key) END, '')) AS blocked_by,
  CASE WHEN h.key IS NOT NULL OR (t.status = 'open' AND r.n > 0) THEN {_NOW_US} ELSE t.updated_us END AS updated_us
FROM t LEFT JOIN hit h USING (key) LEFT JOIN rest r USING (key)""")
def complete_tasks(spark, sf_dir):
    """Close all critical open tasks; every waiting open task loses those blockers."""
    tasks = _blocked(spark, sf_dir)
    keys = tasks.where("status = 'open' AND priority = 'critical'").select("key")
    after, _ = backlog.complete_tasks(tasks, keys, "shipped", _now())
    return after.select(
        "key", "status", "resolution", F.md5(F.array_join("blocked_by", ",")).alias("blocked_by"),
        F.unix_micros("updated").alias("updated_us"),
    )


@query("complete_tasks_refused", f"""
WITH {_T}, asked AS (SELECT key FROM t WHERE status = 'paused' UNION SELECT 'X' || r_regionkey FROM region)
SELECT a.key, CASE WHEN t.key IS NULL THEN 'Task ''' || a.key || ''' not found' END AS reason, (SELECT count(*) FROM t WHERE status = 'closed') AS n_closed_after
FROM asked a LEFT JOIN t USING (key)""")
def complete_tasks_refused(spark, sf_dir):
    """Unknown keys among the requested ones: the report names them and nothing is closed."""
    tasks = inputs.tasks(spark, sf_dir).withColumn("blocked_by", F.array().cast("array<string>"))
    unknown = table(spark, sf_dir, "region").select(F.concat(F.lit("X"), F.col("r_regionkey").cast("string")).alias("key"))
    keys = tasks.where("status = 'paused'").select("key").unionByName(unknown)
    after, report = backlog.complete_tasks(tasks, keys, "shipped", _now())
    closed = after.agg(F.count_if(F.col("status") == "closed").alias("n")).scalar()
    return report.select("key", "reason", closed.alias("n_closed_after"))


_PATCHED = f"""
{_T}, p AS (SELECT 'F' || c_custkey AS key, CASE WHEN c_acctbal > 0 THEN 'paused' END AS status, CASE WHEN c_nationkey > 12 THEN 'waits for stock' END AS resolution,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'New title ' || c_custkey END AS title FROM customer),
j AS (SELECT p.key, p.status, p.resolution, p.title, t.status AS old, t.key IS NOT NULL AS known,
  CASE WHEN t.key IS NULL THEN 'Task ''' || p.key || ''' not found'
    WHEN p.status IS NOT NULL AND t.status <> p.status AND p.resolution IS NULL THEN 'Field ''resolution'' (min 5 chars) required when changing status from ''' || t.status || ''' to ''' || p.status || '''.'
    WHEN t.status = 'closed' AND p.status = 'paused' THEN 'Invalid transition from ''closed'' to ''paused''' END AS reason
  FROM p LEFT JOIN t USING (key))"""


def _patches(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("F"), F.col("c_custkey").cast("string")).alias("key"),
        F.when(F.col("c_acctbal") > 0, "paused").alias("status"),
        F.when(F.col("c_nationkey") > 12, "waits for stock").alias("resolution"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("New title "), F.col("c_custkey").cast("string"))).alias("title"),
    )


@query("update_tasks", f"""
WITH {_PATCHED}
SELECT t.key, coalesce(j.status, t.status) AS status, coalesce(j.title, t.title) AS title, j.resolution, CASE WHEN j.key IS NOT NULL THEN {_NOW_US} ELSE t.updated_us END AS updated_us
FROM t LEFT JOIN (SELECT * FROM j WHERE reason IS NULL) j USING (key)""")
def update_tasks(spark, sf_dir):
    after, _ = backlog.update_tasks(
        inputs.tasks(spark, sf_dir), _patches(spark, sf_dir), _now(), rules.transitions_table(spark)
    )
    return after.select("key", "status", "title", "resolution", F.unix_micros("updated").alias("updated_us"))


@query("update_report", f"WITH {_PATCHED} SELECT key, reason FROM j")
def update_report(spark, sf_dir):
    _, report = backlog.update_tasks(
        inputs.tasks(spark, sf_dir), _patches(spark, sf_dir), _now(), rules.transitions_table(spark)
    )
    return report


_LEGACY = """
g AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'paused' ELSE 'done' END AS file_key,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE 'T-' || o_orderkey || '.7' END AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Ф' WHEN '2-HIGH' THEN 'TD' WHEN '4-NOT SPECIFIED' THEN 'zz' END AS type,
  CASE WHEN o_totalprice > 100000 THEN 'Order ' || o_orderkey END AS title, CASE WHEN o_totalprice > 300000 THEN 'blocked' END AS status FROM orders)"""


def _legacy(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    prio, price, none = F.col("o_orderpriority"), F.col("o_totalprice"), F.lit(None).cast("string")
    return o.select(
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "paused").otherwise("done").alias("file_key"),
        F.when(prio == "3-MEDIUM", "").otherwise(F.concat(F.lit("T-"), F.col("o_orderkey").cast("string"), F.lit(".7"))).alias("id"),
        F.when(prio == "1-URGENT", "Ф").when(prio == "2-HIGH", "TD").when(prio == "4-NOT SPECIFIED", "zz").alias("type"),
        F.when(price > 100000, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("title"),
        F.when(price > 300000, "blocked").alias("status"),
        none.alias("priority"), F.lit(None).cast("timestamp").alias("updated"), none.alias("problem"),
        none.alias("solution"), none.alias("comments"),
        F.lit(None).cast("array<string>").alias("blocked_by"), F.lit(None).cast("array<string>").alias("where"),
    )


@query("legacy_etl", f"""
WITH {_LEGACY}
SELECT CAST(CASE type WHEN 'Ф' THEN 1000000 WHEN 'TD' THEN 3000000 WHEN 'zz' THEN 4000000 ELSE 1000000 END + o_orderkey AS BIGINT) AS id, id AS key,
  coalesce(title, 'No Title') AS title, CASE type WHEN 'Ф' THEN 'F' WHEN 'TD' THEN 'TD' WHEN 'zz' THEN 'zz' ELSE 'F' END AS type,
  coalesce(status, CASE file_key WHEN 'active' THEN 'open' WHEN 'paused' THEN 'paused' ELSE 'closed' END) AS status, 'medium' AS priority
FROM g WHERE id <> ''""")
def legacy_etl(spark, sf_dir):
    good, _, _ = etl_legacy_tasks(_legacy(spark, sf_dir), "kb", _now())
    return good.select("id", "key", "title", "type", "status", "priority")


@query("legacy_etl_report", f"""
WITH {_LEGACY} SELECT file_key, count(*) FILTER (id <> '') AS created, count(*) FILTER (id = '') AS errors FROM g GROUP BY file_key""")
def legacy_etl_report(spark, sf_dir):
    _, _, report = etl_legacy_tasks(_legacy(spark, sf_dir), "kb", _now())
    return report


@query("legacy_etl_errors", f"""
WITH {_LEGACY} SELECT file_key, title, 'Missing task ID' AS error FROM g WHERE id = ''""")
def legacy_etl_errors(spark, sf_dir):
    _, errors, _ = etl_legacy_tasks(_legacy(spark, sf_dir), "kb", _now())
    return errors


_DOC = """'---' || chr(10) || 'id: ' || id || chr(10) || 'key: ' || key || chr(10) || 'title: ' || title || chr(10) || 'type: ' || type || chr(10) || 'status: ' || status || chr(10)
  || 'priority: ' || priority || chr(10) || 'updated: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || chr(10) || 'project: ' || project || chr(10) || '---' || chr(10) || chr(10)
  || '## Problem' || chr(10) || problem || chr(10) || chr(10) || '## Solution' || chr(10) || 'Ship it' || chr(10)"""


@query("task_documents", f"""
WITH {_T} SELECT key, CASE status WHEN 'closed' THEN 'done' WHEN 'paused' THEN 'paused' ELSE 'active' END AS status_dir, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE status WHEN 'closed' THEN 'done/' || year(o_orderdate) || '/' WHEN 'paused' THEN 'paused/' ELSE 'active/' END || key || '.md' AS path, md5({_DOC}) AS digest FROM t""")
def task_docs(spark, sf_dir):
    docs = task_documents(inputs.tasks(spark, sf_dir))
    return docs.select("key", "status_dir", "year", "path", F.md5("content").alias("digest"))


@query("task_document_reader", f"""
WITH {_T} SELECT id, key, title, type, status, priority, project, problem, 'Ship it' AS solution, CAST(NULL AS VARCHAR) AS error FROM t
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Invalid document (no front matter)' FROM part""")
def task_document_reader(spark, sf_dir):
    """Task documents written and read back, and part names that are no task documents."""
    docs = task_documents(inputs.tasks(spark, sf_dir)).select("path", "content")
    plain = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_name").alias("content"))
    read = read_task_docs(docs.unionByName(plain))
    return read.select("id", "key", "title", "type", "status", "priority", "project", "problem", "solution", "error")


@query("key_number", "SELECT c_custkey AS id, CAST(c_custkey AS BIGINT) AS n, CAST(0 AS BIGINT) AS none FROM customer")
def key_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), key_number("c_name").alias("n"), key_number("c_mktsegment").alias("none")
    )


_TASK_TEXT = "SELECT key, title || ' ' || problem AS text FROM t"


@query("semantic_tasks", f"""
WITH {_T}, qs AS (SELECT DISTINCT c_mktsegment AS qid, 'customer ' || c_mktsegment || ' waits' AS text FROM customer),
tv AS MATERIALIZED ({inputs.hashed_sql(_TASK_TEXT, 'key', 'text')}),
qv AS MATERIALIZED ({inputs.hashed_sql('SELECT * FROM qs', 'qid', 'text', None)}),
near AS ({inputs.near_sql('qv', 'tv', 'qid', 'key', 5)})
SELECT n.qid, CAST(n.rank AS INTEGER) AS rank, n.key, t.title, t.status, round(n.distance, 4) AS score FROM near n JOIN t USING (key)""")
def semantic_tasks(spark, sf_dir):
    queries = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("qid"), F.concat(F.lit("customer "), "c_mktsegment", F.lit(" waits")).alias("query")
    ).distinct()
    found = search_tasks_semantic(queries, inputs.tasks(spark, sf_dir, spread=True))
    return found.withColumn("score", F.round("score", 4))
