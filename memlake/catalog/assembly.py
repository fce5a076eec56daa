"""Named queries: manifests, checks, decisions, skills and context bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.catalog import inputs
from memlake.catalog.base import query, table
from memlake.functions import text
from memlake.plans import assemble as plans

_MD = f"md AS ({inputs.MARKDOWN_SQL})"


def _docs(spark, sf_dir):
    """Conversation documents; every conversation is a project."""
    return inputs.markdown(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("project"), "path", "content", "conv_id", "turn", "role"
    )


def _manifests(spark, sf_dir):
    """One build per conversation: a title, then every turn's document in a mode by its role."""
    docs = _docs(spark, sf_dir)
    rules = F.array(F.struct(*[
        F.lit(v).cast("string").alias(n) for n, v in [
            ("preset", "comments"), ("regex", r"TD-(\d+)"), ("replace", r"[\1]"), ("replace_text", "NASA"),
            ("with_text", "{{project_name}}"), ("remove_section", None),
        ]
    ]))
    role = F.col("role")
    steps = docs.select(
        "project", F.lit("all").alias("build"), F.lit("1.0").alias("version"), (F.col("turn") + 1).cast("int").alias("step"),
        F.lit("include_artifact").alias("action"), "path",
        F.when(role == "user", "full").when(role == "assistant", "regex").otherwise("outline_only").alias("mode"),
        F.when(role == "assistant", "Tail").alias("section_name"),
        F.when(role == "assistant", r"memo by (\w+) ends").alias("regex"),
        (role == "assistant").alias("skip_reference"),
        F.when(role == "user", rules).alias("sanitize"),
    )
    heads = docs.select("project").distinct().select(
        "project", F.lit("all").alias("build"), F.lit("1.0").alias("version"), F.lit(0).alias("step"),
        F.lit("append_text").alias("action"), F.lit("# {{PROJECT_NAME}} {{Version}} {{date}} {{x}} {{y}}").alias("content"),
    )
    return steps.unionByName(heads, allowMissingColumns=True), docs


_PARTS = f"""
{_MD},
parts AS (
  SELECT 'c' || conv_id AS project, CAST(turn + 1 AS INTEGER) AS step,
    CASE role WHEN 'assistant' THEN 'assistant'
      WHEN 'user' THEN chr(10) || chr(10) || '--- Artifact: ' || path || ' ---' || chr(10) || chr(10) ||
        replace(regexp_replace(regexp_replace(rtrim(content, chr(10)), '(?s)<!-- .*? -->', '[' || '\\1' || ']', 'g'), 'TD-(\\d+)', '[\\1]', 'g'), 'NASA', 'c' || conv_id)
      ELSE chr(10) || chr(10) || '--- Artifact: ' || path || ' ---' || chr(10) || chr(10) || '# Conversation ' || conv_id || chr(10) || '### Tail' END AS part
  FROM md
  UNION ALL SELECT DISTINCT 'c' || conv_id, 0, '# c' || conv_id || ' 1.0 2024-01-31 v {{{{y}}}}' FROM md)"""


@query("assemble_parts", f"WITH {_PARTS.replace("'[' || '\\1' || ']'", "'[]'")} SELECT project, step, md5(part) AS digest FROM parts")
def assemble_parts(spark, sf_dir):
    manifests, docs = _manifests(spark, sf_dir)
    parts = plans.assemble_parts(_keep_comments(manifests), docs.drop("conv_id", "turn", "role"), "2024-01-31", {"x": "v"})
    return parts.select("project", "step", F.md5("part").alias("digest"))


def _keep_comments(manifests):
    """Presets take no groups, so their replacement is plain text."""
    split = F.transform(
        "sanitize",
        lambda r: F.struct(
            F.lit(None).cast("string").alias("preset"), r["regex"].alias("regex"), r["replace"].alias("replace"),
            r["replace_text"].alias("replace_text"), r["with_text"].alias("with_text"), r["remove_section"].alias("remove_section"),
        ),
    )
    none = F.lit(None).cast("string")
    drop = F.array(F.struct(
        F.lit("comments").alias("preset"), none.alias("regex"), F.lit("[]").alias("replace"), none.alias("replace_text"),
        none.alias("with_text"), none.alias("remove_section"),
    ))
    return manifests.withColumn("sanitize", F.when(F.col("sanitize").isNotNull(), F.concat(drop, split)))


@query("assemble_files", f"""
WITH {_PARTS.replace("'[' || '\\1' || ']'", "'[]'")} SELECT project, md5(string_agg(part, chr(10) ORDER BY step)) AS digest, CAST(NULL AS VARCHAR) AS error FROM parts GROUP BY project""")
def assemble_files(spark, sf_dir):
    manifests, docs = _manifests(spark, sf_dir)
    built = plans.assemble(_keep_comments(manifests), docs.drop("conv_id", "turn", "role"), "2024-01-31", {"x": "v"})
    return built.select("project", F.md5("content").alias("digest"), "error")


@query("assemble_directory", f"""
WITH {_MD}, f AS (SELECT 'c' || conv_id AS project, role || '.md' AS file, max(turn) AS turn FROM md GROUP BY ALL)
SELECT f.project, f.file, md5(rtrim(md.content, chr(10))) AS digest, CAST(NULL AS VARCHAR) AS error FROM f JOIN md ON f.project = 'c' || conv_id AND f.turn = md.turn
UNION ALL SELECT DISTINCT 'c' || conv_id, 'notes.md', md5('one' || chr(10) || 'two' || chr(10)), NULL FROM md""")
def assemble_directory(spark, sf_dir):
    """Directory builds: the last turn of a role is its file, appended texts gather in another."""
    docs = _docs(spark, sf_dir)
    include = docs.select(
        "project", F.lit("dir").alias("build"), F.lit("1").alias("version"), (F.col("turn") + 2).cast("int").alias("step"),
        F.lit("include_artifact").alias("action"), "path", F.concat("role", F.lit(".md")).alias("filename"),
        F.lit("directory").alias("format"),
    )
    notes = docs.select("project").distinct().select(
        "project", F.lit("dir").alias("build"), F.lit("1").alias("version"), F.inline(F.array(
            F.struct(F.lit(0).alias("step"), F.lit("one").alias("content")), F.struct(F.lit(1).alias("step"), F.lit("two").alias("content")),
        )),
    ).select("*", F.lit("append_text").alias("action"), F.lit("notes.md").alias("filename"), F.lit("directory").alias("format"))
    built = plans.assemble(include.unionByName(notes, allowMissingColumns=True), docs.drop("conv_id", "turn", "role"), "2024-01-31")
    return built.select("project", "file", F.md5("content").alias("digest"), "error")


@query("assert_docs", f"""
WITH {_MD}
SELECT path AS check_id, CASE role WHEN 'system' THEN NULL WHEN 'user' THEN 'user' ELSE 'ConversationTurnNotesnotRoleTail' END AS actual,
  role <> 'system' AND turn % 2 = 0 AS passed,
  CASE WHEN role = 'system' THEN 'Validation failed: Section ''Role system'' not found in ' || path
    WHEN turn % 2 = 1 THEN CASE role WHEN 'user' THEN 'bad role' ELSE 'Validation failed for ' || path || '. Expected ''x'', but got ''ConversationTurnNotesnotRoleTail''' END END AS error
FROM md""")
def assert_docs(spark, sf_dir):
    """One check per document: the role under its heading, or all heading words put together."""
    docs = _docs(spark, sf_dir)
    role, even = F.col("role"), F.col("turn") % 2 == 0
    helper = role == "assistant"
    checks = docs.select(
        F.col("path").alias("check_id"), "project", "path",
        F.when(helper, r"^#+ (\w+)").otherwise(r"next_agent_role: (\w+)").alias("regex"),
        F.when(even, F.when(helper, "ConversationTurnNotesnotRoleTail").otherwise(F.concat(F.lit(" "), role))).otherwise("x").alias("expected"),
        F.when(helper, None).otherwise(F.concat(F.lit("Role "), role)).alias("section_name"),
        helper.alias("use_findall"),
        F.when(role == "user", "bad role").alias("error_message"),
    )
    judged = plans.assert_docs(checks, docs.select("project", "path", "content"))
    return judged.select("check_id", "actual", "passed", "error")


@query("assemble_asserted", f"""
WITH {_PARTS.replace("'[' || '\\1' || ']'", "'[]'")},
bad AS (SELECT 'c' || conv_id AS project, arg_min('Validation failed for ' || path || '. Expected ''user'', but got ''' || role || chr(39), turn) AS error
  FROM md WHERE turn % 4 = 2 AND role <> 'user' GROUP BY conv_id),
built AS (SELECT project, md5(string_agg(part, chr(10) ORDER BY step)) AS digest FROM parts GROUP BY project)
SELECT project, CASE WHEN error IS NULL THEN digest END AS digest, error FROM built LEFT JOIN bad USING (project)""")
def assemble_asserted(spark, sf_dir):
    """The same builds with checks among their steps: every fourth turn from the third on has to be a user's."""
    manifests, docs = _manifests(spark, sf_dir)
    checks = docs.where(F.col("turn") % 4 == 2).select(
        "project", F.lit("all").alias("build"), F.lit("1.0").alias("version"), (F.col("turn") + 1000).cast("int").alias("step"),
        F.lit("validate").alias("action"), "path", F.lit(r"^Opening by (\w+)").alias("regex"), F.lit("user").alias("expected"),
    )
    steps = _keep_comments(manifests).unionByName(checks, allowMissingColumns=True)
    built = plans.assemble(steps, docs.drop("conv_id", "turn", "role"), "2024-01-31", {"x": "v"})
    return built.select("project", F.md5("content").alias("digest"), "error")


@query("build_versions", f"""
WITH {_MD} SELECT 'c' || conv_id || '/' || turn AS project, CASE WHEN role = 'system' THEN NULL ELSE CAST(turn AS VARCHAR) END AS version,
  CASE WHEN role = 'system' THEN 'Version regex ''## Turn (\\d+)'' not matched in file ''' || path || '''' END AS error FROM md""")
def build_versions(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("project", F.concat_ws("/", "project", "turn"))
    sources = docs.select("project", F.lit("b").alias("build"), "path", F.lit(r"## Turn (\d+)").alias("regex"))
    return plans.resolve_version(sources, docs).select("project", "version", "error")


# --- role context: nations are projects, market segments are roles ----------------------------

def _knowledge(spark, sf_dir):
    """Documents of every nation's project, the role profiles, and the requests."""
    nation = table(spark, sf_dir, "nation")
    seg = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("role")).distinct()
    project = F.col("n_name")
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    doc = lambda path, content: F.struct(F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"), content.alias("content"))
    decision = lambda n: F.concat(F.lit(f"docs/decisions/adr/000{n}-d"), key, F.lit(".md"))
    row = lambda n, roles: F.concat(F.lit(f"| {n} | [D{n}](adr/000{n}-d"), key, F.lit(f".md) | ok | {roles} |\n"))
    index = F.concat(
        F.lit("# Index\n## Foundational ADRs\n| id | link | state | roles |\n"), row(1, "all"), row(2, "building, machinery"),
        row(3, "furniture"), F.lit("## Other\n| 9 | [D9](adr/0009-x.md) | ok | all |\n"),
    )
    docs = nation.select(project.alias("project"), F.inline(F.array(
        doc("session.md", F.concat(F.lit("# Log\nnext_agent_role: "), F.when(F.col("n_regionkey") < 4, "Building Agent").otherwise("nobody"), F.lit("\nPhase 3\n"))),
        doc("spec.md", F.concat(F.lit("Spec of "), project, F.lit("\n"))),
        doc(plans.CORE_GUIDELINES, F.lit("Core.\n")),
        doc("guides/g.md", F.lit("Guide.\n")),
        doc(plans.DECISION_INDEX, index),
        doc(decision(1), F.concat(F.lit("# One for "), project, F.lit("\n\n## Summary\n\nFirst.\n\n## More\nx"))),
        doc(decision(2), F.lit("Second, no summary.")),
        doc("skills/s.md", F.lit("---\ntitle: Skill\ndescription: Does it\ntriggers: [a, 'b']\nscope: all\n---\nbody")),
    )))
    ids = F.when(F.col("role") == "building", F.array(F.lit("0002"), F.lit("0001"), F.lit("0003"))).otherwise(F.array(F.lit("0001")))
    skills = F.when(F.col("role") == "building", F.array(F.lit("skills/s.md"), F.lit("skills/none.md"))).otherwise(F.array().cast("array<string>"))
    profiles = seg.where("role <> 'furniture'").select(
        "role", F.lit("guides/g.md").alias("guideline"), ids.alias("adrs"), skills.alias("playbooks"),
        F.when(F.col("role") != "machinery", "qa").alias("next"), (F.col("role") == "building").alias("requires_approval"),
    )
    return docs, profiles, nation.select(project.alias("project")), seg


_ROLES = """
seg AS (SELECT DISTINCT lower(c_mktsegment) AS role FROM customer),
n AS (SELECT n_name AS project, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS k, n_regionkey FROM nation),
one AS (SELECT project, '# One for ' || project || chr(10) || '**Source:** `docs/decisions/adr/0001-d' || k || '.md`' || chr(10) || chr(10) || 'First.' AS s FROM n)"""


@query("role_decisions", f"""
WITH {_ROLES},
want AS (SELECT role, unnest(CASE WHEN role = 'building' THEN ['0002', '0001', '0003'] WHEN role = 'furniture' THEN ['0001', '0002', '0003'] ELSE ['0001'] END) AS id,
  unnest(range(CASE WHEN role IN ('building', 'furniture') THEN 3 ELSE 1 END)) AS position FROM seg)
SELECT n.project, role, CAST(position AS INTEGER) AS position, id AS decision_id, 'docs/decisions/adr/' || id || '-d' || k || '.md' AS path, id = '0003' AS missing,
  CASE id WHEN '0001' THEN s WHEN '0002' THEN 'Second, no summary.' END AS summary
FROM n JOIN one USING (project) CROSS JOIN want""")
def role_decisions(spark, sf_dir):
    """Decisions of every project for every role; a role without a profile gets the whole index."""
    docs, profiles, projects, roles = _knowledge(spark, sf_dir)
    requests = _every(projects, roles)
    return plans.role_decisions(requests, profiles, docs)


def _every(projects, roles):
    """Each project with each role: the roles travel as one array value of a handful of names."""
    names = roles.agg(F.array_sort(F.collect_set("role")).alias("r")).scalar()
    return projects.withColumn("role", names).withColumn("role", F.explode("role"))


@query("decision_index", """
SELECT n_name AS project, 'docs/decisions/adr/0001-d' || k || '.md,docs/decisions/adr/0002-d' || k || '.md' AS building,
  'docs/decisions/adr/0001-d' || k || '.md,docs/decisions/adr/0003-d' || k || '.md' AS furniture
FROM (SELECT n_name, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS k FROM nation) x""")
def decision_index(spark, sf_dir):
    docs, _, _, _ = _knowledge(spark, sf_dir)
    index = docs.where(F.col("path") == plans.DECISION_INDEX)
    paths = lambda role: F.array_join(text.parse_decision_index("content", F.lit(role)), ",").alias(role.lower())
    return index.select("project", paths("Building"), paths("FURNITURE"))


_BUNDLE = """
seg_ok AS (SELECT string_agg(role, ', ' ORDER BY role) AS valid FROM seg WHERE role <> 'furniture'),
skill AS (SELECT 'Use `read_project_artifacts` to load a skill by path when the task matches its triggers.' || chr(10) || chr(10) || '- Skill [skills/s.md]' || chr(10) || '  Does it' || chr(10) || '  Triggers: a, b' || chr(10) || '  Scope: all' AS s),
dec AS (SELECT project, role, CASE role WHEN 'building' THEN 'Second, no summary.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || one.s ELSE one.s END AS d FROM one CROSS JOIN seg)"""


@query("context_bundles", f"""
WITH {_ROLES}, {_BUNDLE},
req AS (SELECT project, role AS asked, role, CAST(NULL AS VARCHAR) AS session FROM n CROSS JOIN seg
  UNION ALL SELECT project, NULL, CASE WHEN n_regionkey < 4 THEN 'Building Agent' ELSE 'nobody' END, '# Log' || chr(10) || 'next_agent_role: ' || CASE WHEN n_regionkey < 4 THEN 'Building Agent' ELSE 'nobody' END || chr(10) || 'Phase 3' FROM n)
SELECT req.project, req.asked AS asked_role, req.role,
  CASE WHEN lower(req.role) IN ('furniture', 'nobody') THEN NULL ELSE md5('=== YOUR ROLE: ' || req.role || ' ===' || chr(10) || chr(10) || '=== CORE GUIDELINES ===' || chr(10) || 'Core.' || chr(10) || chr(10)
    || '=== PHASE GUIDELINES (' || req.role || ') ===' || chr(10) || 'Guide.' || chr(10) || chr(10) || coalesce('=== SESSION STATE ===' || chr(10) || session || chr(10), '')
    || '=== SPEC:===' || chr(10) || 'Spec of ' || req.project || chr(10) || '=== FOUNDATIONAL DECISIONS ===' || chr(10) || dec.d
    || CASE WHEN dec.role = 'building' THEN chr(10) || '=== PLAYBOOKS ===' || chr(10) || (SELECT s FROM skill) ELSE '' END
    || CASE WHEN dec.role = 'machinery' THEN '' WHEN dec.role = 'building' THEN chr(10) || '=== NEXT STEP ===' || chr(10) || 'HARD STOP — await explicit human GO before proceeding.' || chr(10) || 'Next role on approval: qa' || chr(10)
       ELSE chr(10) || '=== NEXT STEP ===' || chr(10) || 'Auto-advance — no approval gate. On completion, set next_agent_role to: qa' || chr(10) END) END AS digest,
  CASE WHEN lower(req.role) IN ('furniture', 'nobody') THEN 'Unknown role ''' || req.role || '''. Valid roles: ' || (SELECT valid FROM seg_ok) || '.' END AS error
FROM req LEFT JOIN dec ON dec.project = req.project AND dec.role = replace(lower(req.role), ' agent', '')""")
def context_bundles(spark, sf_dir):
    """Bundles of every project: one per role, and one for the role its session names."""
    docs, profiles, projects, roles = _knowledge(spark, sf_dir)
    requests = _every(projects, roles).unionByName(projects.withColumn("role", F.lit(None).cast("string")))
    made = plans.context_bundles(requests, profiles, docs)
    return made.select("project", "asked_role", "role", F.md5("bundle").alias("digest"), "error")


@query("role_guidelines", f"""
WITH {_ROLES}, {_BUNDLE}
SELECT dec.project, dec.role, md5('=== ROLE GUIDELINES ===' || chr(10) || 'Guide.' || chr(10) || chr(10) || '=== FOUNDATIONAL DECISIONS ===' || chr(10) || dec.d
  || CASE WHEN dec.role = 'building' THEN chr(10) || chr(10) || '=== PLAYBOOKS ===' || chr(10) || (SELECT s FROM skill) ELSE '' END || chr(10)) AS digest FROM dec WHERE role <> 'furniture'""")
def role_guidelines(spark, sf_dir):
    docs, profiles, projects, roles = _knowledge(spark, sf_dir)
    requests = _every(projects, roles.where("role <> 'furniture'"))
    made = plans.context_bundles(requests, profiles, docs, with_context=False)
    return made.select("project", "role", F.md5("bundle").alias("digest"))
