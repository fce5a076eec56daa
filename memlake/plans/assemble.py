"""Context assembly: manifests into documents, manifest checks, decisions and role bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import markdown
from memlake.functions.exprs import col, join_lines, let, split_lines, strip
from memlake.functions.paths import base_name
from memlake.functions.text import (
    NOISE,
    decision_summary,
    normalize_role,
    parse_decision_index,
    parse_next_role,
    render,
    skill_stub,
    template_variables,
)
from memlake.operators.skew import asked_for, salted_join
from memlake.plans.registry import ACTIONS
from memlake.session import cut_lineage

# Well-known documents, default gate texts and the notice above a skill list.
DECISION_INDEX = "docs/decisions/0000-index.md"
CORE_GUIDELINES = "docs/manuals/guidelines/core.md"
HARD_STOP = "docs/manuals/guidelines/hard_stop.md"
AUTO_ADVANCE = "docs/manuals/guidelines/auto_advance.md"
HARD_STOP_TEXT = (
    "HARD STOP — await explicit human GO before proceeding.\nNext role on approval: {next_role}\n"
)
AUTO_ADVANCE_TEXT = (
    "Auto-advance — no approval gate. On completion, set next_agent_role to: {next_role}\n"
)
SKILL_NOTICE = (
    "Use `read_project_artifacts` to load a skill by path when the task matches its triggers."
)
DECISION_RULE = "\n\n---\n\n"

RULES = "array<struct<preset:string,regex:string,replace:string,replace_text:string,with_text:string,remove_section:string>>"

STEP_FIELDS = {
    "project": "string", "build": "string", "version": "string", "step": "int", "action": "string",
    "path": "string", "source_project": "string", "mode": "string", "section_name": "string",
    "regex": "string", "content": "string", "filename": "string", "skip_reference": "boolean",
    "format": "string", "sanitize": RULES, "expected": "string", "use_findall": "boolean", "error_message": "string",
}
# Fixed value: the step that checks a document instead of giving a part.
VALIDATE = "validate"

_GROUP = r"\\.|\[(?:\\.|[^\]\\])*\]|(\((?!\?)|\(\?P?<[A-Za-z])"


def _java(pattern: Column) -> Column:
    """A pattern in the syntax of the engine, with line mode and dots that cross lines."""
    return F.concat(F.lit("(?ms)"), F.replace(pattern, F.lit("(?P<"), F.lit("(?<")))


def group_count(pattern: Column) -> Column:
    """Number of capturing groups of a pattern."""
    opened = F.regexp_extract_all(pattern, F.lit(_GROUP), 1)
    return F.size(F.filter(opened, lambda x: x != ""))


def first_match(text: Column, pattern: Column) -> Column:
    """First group of the first match, or the whole match; null without a match."""
    wanted = F.least(group_count(pattern), F.lit(1))
    return F.when(
        F.regexp_like(text, _java(pattern)),
        F.call_function("regexp_extract", text, _java(pattern), wanted),
    )


def all_matches(text: Column, pattern: Column) -> Column:
    """All matches, each as its groups put together, as one text; null without a match."""
    n = group_count(pattern)
    groups = F.when(n == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    columns = F.transform(groups, lambda g: F.regexp_extract_all(text, _java(pattern), g))
    joined = let(
        columns,
        lambda cs: F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.size(cs[0]) - 1),
                lambda i: F.array_join(F.transform(cs, lambda c: F.get(c, i)), ""),
            ),
            "",
        ),
    )
    return F.when(F.regexp_like(text, _java(pattern)), joined)


def sanitize_by(text: Column, sanitize: Column) -> Column:
    """Apply an array of rules from a column, in order."""
    presets = F.create_map(*[x for k, v in NOISE.items() for x in (F.lit(k), F.lit(v))])

    def one(acc, rule):
        plain = F.replace(F.coalesce(rule["replace"], F.lit("")), F.lit("$"), F.lit("\\$"))
        to = F.regexp_replace(plain, r"\\(\d)", r"\$$1")
        known = F.element_at(presets, rule["preset"])
        out = F.when(
            known.isNotNull(), F.regexp_replace(acc, F.concat(F.lit("(?ms)"), known), to)
        ).otherwise(acc)
        return let(out, lambda a: rest(a, rule, to))

    def rest(acc, rule, to):
        out = F.when(
            F.coalesce(rule["regex"], F.lit("")) != "", F.regexp_replace(acc, _java(rule["regex"]), to)
        ).otherwise(acc)
        return let(out, lambda a: let(literal(a, rule), lambda b: section(b, rule)))

    def literal(acc, rule):
        return F.when(
            F.coalesce(rule["replace_text"], F.lit("")) != "",
            F.replace(acc, rule["replace_text"], F.coalesce(rule["with_text"], F.lit(""))),
        ).otherwise(acc)

    def section(acc, rule):
        named = F.coalesce(rule["remove_section"], F.lit("")) != ""
        return F.when(named, markdown.drop_section(acc, rule["remove_section"])).otherwise(acc)

    return F.when(
        F.coalesce(F.size(sanitize), F.lit(0)) > 0, F.aggregate(sanitize, text, one)
    ).otherwise(text)


def _whole(text: Column) -> Column:
    return join_lines(split_lines(text))


def _steps(manifests: DataFrame) -> DataFrame:
    have = set(manifests.columns)
    return manifests.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in STEP_FIELDS.items()]
    )


def assemble_parts(
    manifests: DataFrame, docs: DataFrame, day: str, variables: dict[str, str] | None = None
) -> DataFrame:
    """Every step of every build as text: project, build, step, part, file, error.

    ``manifests`` has one row per step (STEP_FIELDS); ``docs`` has project, path, content. Steps of
    one build stay separate rows, so a build of any size is written by many tasks. A step whose action is
    neither built in nor registered comes back with an error. A ``validate`` step gives no part: it looks for ``regex``
    (its first match, or with ``use_findall`` all of them) in the document or its ``section_name``, compares it with
    ``expected`` and comes back with an error where they differ.
    """
    steps = _steps(manifests).withColumn("_from", F.coalesce("source_project", "project"))
    text = docs.select(F.col("project").alias("_from"), "path", F.col("content").alias("_text"))
    including = steps.where(F.col("action") == "include_artifact")
    joined = salted_join(
        including, asked_for(text, including, ["_from", "path"]), ["_from", "path"], "left",
        spread=["project", "build", "step"],
    )
    elsewhere = F.coalesce(F.col("action").isin("include_artifact", VALIDATE, *ACTIONS), F.lit(False))
    own = steps.where(~elsewhere).withColumn("_text", F.lit(None).cast("string"))
    rows = joined.unionByName(own, allowMissingColumns=True)
    mode = F.coalesce("mode", F.lit("full"))
    body = F.col("_text")
    outline = markdown.outline(body)
    scoped = F.when(
        F.coalesce("section_name", F.lit("")) != "",
        F.coalesce(markdown.section(body, F.col("section_name"), fence_aware=True), F.lit("")),
    ).otherwise(_whole(body))
    included = (
        F.when(mode == "full", _whole(body))
        .when(mode == "section", markdown.section(body, F.col("section_name")))
        .when(
            mode == "outline_only",
            F.when(F.size(outline) > 0, join_lines(outline)).otherwise(
                F.lit("No Markdown headings found in the file.")
            ),
        )
        .when(mode == "regex", let(scoped, lambda s: F.coalesce(first_match(s, F.col("regex")), F.lit(""))))
    )
    include = F.col("action") == "include_artifact"
    error = (
        F.when(~F.coalesce(F.col("action").isin("include_artifact", "append_text"), F.lit(False)),
               F.concat(F.lit("Unknown pipeline action: '"), F.coalesce("action", F.lit("")), F.lit("'")))
        .when(include & (F.coalesce("path", F.lit("")) == ""), "Action 'include_artifact' requires 'path'")
        .when(include & body.isNull(), F.concat(F.lit("File not found: "), F.col("path")))
        .when(include & (mode == "regex") & F.col("regex").isNull(), "Mode 'regex' requires 'regex' pattern")
        .when(
            include & (mode == "section") & markdown.section(body, F.col("section_name")).isNull(),
            F.concat(F.lit("Section '"), F.coalesce("section_name", F.lit("")), F.lit("' not found in "),
                     F.col("path"), F.lit(".")),
        )
        .when(include & ~mode.isin("full", "section", "outline_only", "regex"),
              F.concat(F.lit("Unknown read mode: "), mode))
    )
    extra = None
    if variables:
        extra = F.create_map(*[F.lit(x) for kv in variables.items() for x in kv])
    known = template_variables(F.col("project"), F.col("build"), F.col("version"), F.lit(day), extra)
    raw = F.when(include, included).otherwise(F.coalesce("content", F.lit("")))
    rows = rows.withColumn("_raw", raw).withColumn("error", error)
    rows = rows.withColumn("_clean", sanitize_by(F.col("_raw"), F.col("sanitize")))
    shown = render(F.col("_clean"), known)
    single = F.coalesce("format", F.lit("single_file")) == "single_file"
    heading = F.when(
        include & single & ~F.coalesce("skip_reference", F.lit(False)),
        F.concat(F.lit("\n\n--- Artifact: "), F.col("path"), F.lit(" ---\n\n")),
    ).otherwise("")
    directory = F.when(include, F.coalesce("filename", base_name("path"))).otherwise(
        F.coalesce("filename", F.lit("appended_text.md"))
    )
    out = rows.select(
        "project", "build", "version", "step", "action",
        F.when(F.col("error").isNull(), F.concat(heading, shown)).alias("part"),
        F.when(~single, directory).alias("file"),
        "error",
    )
    checks = steps.where(F.col("action") == VALIDATE)
    # Most manifests check nothing; then no document is looked up for it.
    if not checks.isEmpty():
        out = out.unionByName(_validated(checks, docs))
    for name, action in ACTIONS.items():
        own_steps = action(steps.where(F.col("action") == name))
        out = out.unionByName(
            own_steps.select("project", "build", "version", "step", "action", F.col("text").alias("part"),
                             F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("error"))
        )
    return out


def _validated(steps: DataFrame, docs: DataFrame) -> DataFrame:
    """Checks as steps without a part."""
    step = ["project", "build", "version", "step", "action"]
    checks = steps.select(
        F.struct(*step).alias("check_id"), F.col("_from").alias("project"), "path", "regex", "expected", "section_name",
        "use_findall", "error_message",
    )
    lacking = (F.coalesce("path", F.lit("")) == "") | (F.coalesce("regex", F.lit("")) == "") | F.col("expected").isNull()
    refused = checks.where(lacking).select(
        "check_id", F.lit("Action 'validate' requires 'path', 'regex', and 'expected'").alias("error"))
    judged = assert_docs(checks.where(~lacking), docs).select("check_id", "error").unionByName(refused)
    return judged.select(
        *[F.col("check_id")[c].alias(c) for c in step], F.lit(None).cast("string").alias("part"),
        F.lit(None).cast("string").alias("file"), "error")


def assemble(
    manifests: DataFrame, docs: DataFrame, day: str, variables: dict[str, str] | None = None
) -> DataFrame:
    """One row per output file: project, build, file (null for the single file), content, error.

    The parts of a single file are joined by newlines in step order. In a directory build appended
    text grows its file and an included document replaces what the file held. A failing step, a
    ``validate`` step among them, fails its build. The parts of one file meet in one row because the file itself is that row; use
    ``assemble_parts`` for builds that are larger than one value may be.
    """
    # Read three times: for errors, for the last document of a file, and for the texts.
    parts = cut_lineage(assemble_parts(manifests, docs, day, variables))
    builds = parts.groupBy("project", "build").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("step"))).alias("error")
    )
    last = parts.where(F.col("file").isNotNull() & (F.col("action") == "include_artifact")).groupBy(
        "project", "build", "file"
    ).agg(F.max("step").alias("_from"))
    same_file = F.col("p.file").eqNullSafe(F.col("l.file"))
    kept = (
        parts.alias("p")
        .join(last.alias("l"), (F.col("p.project") == F.col("l.project")) & (F.col("p.build") == F.col("l.build")) & same_file, "left")
        .where(F.coalesce("action", F.lit("")) != VALIDATE)
        .where(F.col("_from").isNull() | (F.col("step") >= F.col("_from")))
        .select("p.project", "p.build", "p.file", "step", "action", "part")
    )
    grouped = kept.groupBy("project", "build", "file").agg(
        F.array_sort(F.collect_list(F.struct("step", "action", "part"))).alias("_parts")
    )
    one = F.array_join(F.transform("_parts", lambda p: p["part"]), "\n")
    many = F.array_join(
        F.transform(
            "_parts",
            lambda p: F.when(p["action"] == "append_text", F.concat(p["part"], F.lit("\n"))).otherwise(p["part"]),
        ),
        "",
    )
    joined = grouped.join(builds, ["project", "build"])
    return joined.select(
        "project", "build", "file",
        F.when(F.col("error").isNull(), F.when(F.col("file").isNull(), one).otherwise(many)).alias("content"),
        "error",
    )


def resolve_version(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Build versions taken from a document: project, build, path, regex in; version, error out."""
    text = docs.select("project", "path", F.col("content").alias("_text"))
    joined = sources.join(asked_for(text, sources, ["project", "path"]), ["project", "path"], "left")
    found = first_match(F.col("_text"), F.col("regex"))
    error = F.when(
        F.col("_text").isNull(), F.concat(F.lit("Source file for versioning not found: "), F.col("path"))
    ).when(found.isNull(), F.concat(F.lit("Version regex '"), F.col("regex"), F.lit("' not matched in file '"), F.col("path"), F.lit("'")))
    return joined.select("project", "build", found.alias("version"), error.alias("error"))


def assert_docs(checks: DataFrame, docs: DataFrame) -> DataFrame:
    """Check documents against expected values: every check with actual, passed and error.

    ``checks`` has check_id, project, path, regex, expected and may have section_name, use_findall
    and error_message.
    """
    for name, kind in (("section_name", "string"), ("use_findall", "boolean"), ("error_message", "string")):
        if name not in checks.columns:
            checks = checks.withColumn(name, F.lit(None).cast(kind))
    text = docs.select("project", "path", F.col("content").alias("_text"), F.lit(True).alias("_known"))
    asked = asked_for(text, checks, ["project", "path"])
    joined = salted_join(checks, asked, ["project", "path"], "left", spread=["check_id"])
    named = F.coalesce("section_name", F.lit("")) != ""
    scoped = joined.withColumn(
        "_scope", F.when(named, markdown.section(F.col("_text"), F.col("section_name"))).otherwise(F.col("_text"))
    )
    found = F.when(
        F.coalesce("use_findall", F.lit(False)), all_matches(F.col("_scope"), F.col("regex"))
    ).otherwise(first_match(F.col("_scope"), F.col("regex")))
    judged = scoped.withColumn("actual", strip(found)).withColumn("_expected", strip(F.col("expected")))
    reason = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Validation source file not found: "), F.col("path")))
        .when(
            named & (F.coalesce("_scope", F.lit("")) == ""),
            F.coalesce("error_message", F.concat(F.lit("Validation failed: Section '"), F.col("section_name"), F.lit("' not found in "), F.col("path"))),
        )
        .when(
            F.col("actual").isNull(),
            F.coalesce("error_message", F.concat(F.lit("Validation failed: no match for regex '"), F.col("regex"), F.lit("' in "), F.col("path"))),
        )
        .when(
            F.col("actual") != F.col("_expected"),
            F.coalesce("error_message", F.concat(
                F.lit("Validation failed for "), F.col("path"), F.lit(". Expected '"), F.col("_expected"),
                F.lit("', but got '"), F.col("actual"), F.lit("'"),
            )),
        )
    )
    return judged.withColumn("error", reason).select(
        "check_id", "project", "path", "actual", F.col("error").isNull().alias("passed"), "error"
    )


def role_decisions(requests: DataFrame, profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """Decision documents per (project, role): position, decision_id, path, summary, missing.

    A role with a profile gets the decisions its profile lists, by the four-character number that
    opens the file name; a role without one gets every decision of the index.
    """
    index = docs.where(F.col("path") == DECISION_INDEX).select(
        "project", F.posexplode(parse_decision_index("content")).alias("_at", "path")
    ).withColumn("decision_id", F.substring(base_name("path"), 1, 4))
    asked = requests.select("project", "role").distinct().withColumn("_role", normalize_role("role"))
    known = profiles.select(F.col("role").alias("_role"), "adrs")
    state = asked.join(known, "_role", "left")
    # The last path of the index wins should two share a number.
    by_id = index.groupBy("project", "decision_id").agg(F.max_by("path", "_at").alias("path"))
    listed = state.where(F.col("adrs").isNotNull()).select(
        "project", "role", F.posexplode("adrs").alias("_at", "decision_id")
    ).join(by_id, ["project", "decision_id"], "left")
    everything = state.where(F.col("adrs").isNull()).select("project", "role").join(index, "project")
    chosen = listed.unionByName(everything.select(*listed.columns))
    text = docs.select("project", "path", F.col("content").alias("_text"))
    found = chosen.join(asked_for(text, chosen, ["project", "path"]), ["project", "path"], "left")
    return found.select(
        "project", "role", F.col("_at").alias("position"), "decision_id", "path",
        decision_summary("_text", "path").alias("summary"), F.col("_text").isNull().alias("missing"),
    )


def _ordered_text(rows: DataFrame, at: str, text: str, rule: str, name: str) -> DataFrame:
    """Texts of a (project, role) in order as one text; a list is as long as its role profile."""
    grouped = rows.where(F.col(text).isNotNull()).groupBy("project", "role").agg(
        F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.col(text).alias("t")))).alias("_l")
    )
    return grouped.select("project", "role", F.array_join(F.transform("_l", lambda x: x["t"]), rule).alias(name))


def role_skills(requests: DataFrame, profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """Skill listing per (project, role): the notice and one entry per listed, readable skill."""
    asked = requests.select("project", "role").distinct().withColumn("_role", normalize_role("role"))
    listed = asked.join(profiles.select(F.col("role").alias("_role"), "playbooks"), "_role").select(
        "project", "role", F.posexplode("playbooks").alias("_at", "path")
    )
    text = docs.select("project", "path", F.col("content").alias("_text"))
    found = listed.join(asked_for(text, listed, ["project", "path"]), ["project", "path"]).withColumn("_entry", skill_stub("_text", "path"))
    joined = _ordered_text(found, "_at", "_entry", "\n\n", "skills")
    return joined.withColumn("skills", F.concat(F.lit(SKILL_NOTICE + "\n\n"), F.col("skills")))


def _document(docs: DataFrame, path: str, name: str) -> DataFrame:
    return docs.where(F.col("path") == path).select("project", _whole(F.col("content")).alias(name))


def context_bundles(
    requests: DataFrame, profiles: DataFrame, docs: DataFrame, *, with_context: bool = True
) -> DataFrame:
    """Context text per request (project, role): bundle or error.

    A null role is taken from the project's session document, which then is part of the bundle.
    ``with_context`` off gives the short form of guidelines, decisions and skills only.
    """
    session = _document(docs, "session.md", "_session")
    spec = _document(docs, "spec.md", "_spec")
    core = _document(docs, CORE_GUIDELINES, "_core")
    asked = requests.select("project", F.col("role").alias("asked_role")).distinct()
    base = asked.join(session, "project", "left").join(spec, "project", "left").join(core, "project", "left")
    role = F.coalesce("asked_role", parse_next_role("_session"))
    base = base.withColumn("role", role).withColumn("_role", normalize_role("role"))
    valid = profiles.agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("v")).scalar()
    profile = profiles.select(
        F.col("role").alias("_role"), F.col("guideline").alias("_guideline"), F.col("next").alias("_next"),
        F.coalesce("requires_approval", F.lit(True)).alias("_gate"),
    )
    base = base.join(profile, "_role", "left")
    guides = docs.select("project", F.col("path").alias("_guideline"), _whole(F.col("content")).alias("_phase"))
    base = base.join(guides, ["project", "_guideline"], "left")
    keys = base.where(F.col("role").isNotNull()).select("project", "role")
    decisions = _ordered_text(
        role_decisions(keys, profiles, docs).where(~F.col("missing")), "position", "summary", DECISION_RULE, "_decisions"
    )
    skills = role_skills(keys, profiles, docs)
    base = base.join(decisions, ["project", "role"], "left").join(skills, ["project", "role"], "left")
    for path, name in ((HARD_STOP, "_hard"), (AUTO_ADVANCE, "_auto")):
        base = base.join(_document(docs, path, name), "project", "left")
    gate = F.when(F.col("_gate"), F.coalesce("_hard", F.lit(HARD_STOP_TEXT))).otherwise(
        F.coalesce("_auto", F.lit(AUTO_ADVANCE_TEXT))
    )
    next_step = F.when(
        F.coalesce("_next", F.lit("")) != "",
        F.concat(F.lit("\n=== NEXT STEP ===\n"), F.replace(gate, F.lit("{next_role}"), F.col("_next"))),
    )
    empty = F.lit("")
    choice = F.coalesce("_decisions", empty)
    if with_context:
        bundle = F.concat(
            F.lit("=== YOUR ROLE: "), F.col("role"), F.lit(" ===\n\n"),
            F.lit("=== CORE GUIDELINES ===\n"), F.col("_core"), F.lit("\n\n"),
            F.lit("=== PHASE GUIDELINES ("), F.col("role"), F.lit(") ===\n"), F.col("_phase"), F.lit("\n\n"),
            F.when(F.col("asked_role").isNull(), F.concat(F.lit("=== SESSION STATE ===\n"), F.col("_session"), F.lit("\n"))).otherwise(empty),
            F.coalesce(F.concat(F.lit("=== SPEC:===\n"), F.col("_spec"), F.lit("\n")), empty),
            F.lit("=== FOUNDATIONAL DECISIONS ===\n"), choice,
            F.coalesce(F.concat(F.lit("\n=== PLAYBOOKS ===\n"), F.col("skills")), empty),
            F.coalesce(next_step, empty),
        )
    else:
        bundle = F.concat(
            F.lit("=== ROLE GUIDELINES ===\n"), F.col("_phase"),
            F.lit("\n\n=== FOUNDATIONAL DECISIONS ===\n"), choice,
            F.coalesce(F.concat(F.lit("\n\n=== PLAYBOOKS ===\n"), F.col("skills")), empty), F.lit("\n"),
        )
    error = (
        F.when(F.col("role").isNull(), "session.md is missing next_agent_role — cannot resolve agent role.")
        .when(F.col("_core").isNull(), F.lit(f"File {CORE_GUIDELINES} not found."))
        .when(F.col("_guideline").isNull(), F.concat(F.lit("Unknown role '"), F.col("_role"), F.lit("'. Valid roles: "), valid, F.lit(".")))
        .when(F.col("_phase").isNull(), F.concat(F.lit("Error: guideline file not found: "), F.col("_guideline")))
    )
    return base.select(
        "project", "asked_role", "role", F.when(error.isNull(), bundle).alias("bundle"), error.alias("error")
    )
