"""Text clean-up, redaction, templating and small parsers, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.exprs import col, collapse_spaces, let, split_lines, strip
from memlake.functions.markdown import drop_section

# Noise patterns removed before indexing.
NOISE = {
    "change_log": r"> \*\*(?:Version|Версия):[^\n]*\n(?:> \|[^\n]*\n)*+",
    "comments": r"<!-- .*? -->",
}


def clean(text: Column | str, presets: Sequence[str] = ("change_log", "comments")) -> Column:
    """Remove version-log quotes and HTML comments, squeeze blank lines, trim. Null gives ''."""
    out = F.coalesce(col(text), F.lit(""))
    for name in presets:
        out = F.regexp_replace(out, "(?ms)" + NOISE[name], "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def _replacement(text: str) -> str:
    """A replacement text with ``\\1`` groups in the form Spark expects."""
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def sanitize(text: Column | str, rules: Sequence[Mapping[str, str]]) -> Column:
    """Apply rules in order. A rule may name a preset, a regex, a literal and a section to drop."""
    out = col(text)
    for rule in rules or ():
        replacement = _replacement(rule.get("replace") or "")
        if rule.get("preset") in NOISE:
            out = F.regexp_replace(out, "(?ms)" + NOISE[rule["preset"]], replacement)
        if rule.get("regex"):
            out = F.regexp_replace(out, "(?ms)" + rule["regex"], replacement)
        if rule.get("replace_text"):
            out = F.replace(out, F.lit(rule["replace_text"]), F.lit(rule.get("with_text") or ""))
        if rule.get("remove_section"):
            out = drop_section(out, F.lit(rule["remove_section"]))
    return out


_PLACEHOLDER = r"\{\{([^}]+)\}\}"


def render(text: Column | str, variables: Column) -> Column:
    """Fill ``{{KEY}}`` from a map column with upper-case keys; an unknown key stays as written.

    Values are put in once and never expanded again.
    """
    text = col(text)

    def fill(known):
        return lambda piece, key: F.concat(
            piece,
            F.coalesce(
                F.element_at(known, F.upper(key)), F.concat(F.lit("{{"), key, F.lit("}}")), F.lit("")
            ),
        )

    pieces = F.split(text, r"\{\{[^}]+\}\}", -1)
    keys = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), 1)
    return let(variables, lambda known: F.array_join(F.zip_with(pieces, keys, fill(known)), ""))


def unresolved(text: Column | str, variables: Column) -> Column:
    """Placeholder names of the text that the map does not know, sorted."""
    keys = F.regexp_extract_all(col(text), F.lit(_PLACEHOLDER), 1)
    missing = F.filter(keys, lambda k: F.element_at(variables, F.upper(k)).isNull())
    return F.array_sort(F.array_distinct(missing))


def template_variables(
    project: Column, build: Column, version: Column, day: Column, extra: Column | None = None
) -> Column:
    """Built-in variables with the caller's own laid over them. Keys become upper case."""
    base = F.create_map(
        F.lit("VERSION"), version,
        F.lit("PROJECT_NAME"), project,
        F.lit("BUILD_NAME"), build,
        F.lit("DATE"), day,
    )
    base = F.map_filter(base, lambda _, v: v.isNotNull())
    if extra is None:
        return base
    own = F.transform_keys(extra, lambda k, _: F.upper(k))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def redact_paths(message: Column | str, root: str) -> Column:
    """Hide the known root, Windows paths and drive letters in a message."""
    out = F.coalesce(col(message), F.lit(""))
    if root:
        out = F.regexp_replace(out, "(?iu)" + re.escape(root), "[PROJECTS_ROOT]")
    out = F.regexp_replace(out, r"""(?U)[a-zA-Z]:\\[^"'\s,<>|]+""", "[PATH]")
    return F.regexp_replace(out, r"[a-zA-Z]:/", "[PATH]/")



def parse_phase(text: Column | str) -> Column:
    """Number after 'Phase' or 'Step', 1 when there is none."""
    found = F.try_element_at(
        F.regexp_extract_all(col(text), F.lit(r"(?iU)(?:Phase|Step)[:\s]+([0-9]+)"), 1), F.lit(1)
    )
    return F.coalesce(found.cast("int"), F.lit(1))


def parse_next_role(text: Column | str) -> Column:
    """Role named after ``next_agent_role``, or null."""
    found = F.try_element_at(
        F.regexp_extract_all(col(text), F.lit(r"(?iU)next_agent_role[:\s*]+([^\n]+)"), 1), F.lit(1)
    )
    return strip(found)


def normalize_role(role: Column | str) -> Column:
    return strip(F.replace(F.lower(col(role)), F.lit(" agent"), F.lit("")))


def parse_decision_index(text: Column | str, role: Column | str | None = None) -> Column:
    """Paths in the 'Foundational ADRs' table, in order; with a role, only rows open to it."""
    text = col(text)
    block = F.try_element_at(
        F.regexp_extract_all(
            text, F.lit(r"(?isU)##\s+Foundational ADRs.*?(\n.*?)(?=\n##|\z)"), 1
        ),
        F.lit(1),
    )
    wanted = F.lower(strip(col(role))) if role is not None else F.lit("")

    def row(line):
        cells = F.transform(F.split(line, r"\|", -1), lambda c: strip(c))
        return F.struct(
            F.regexp_extract(line, r"(?U)\((adr/[\w\-]+\.md)\)", 1).alias("href"),
            F.lower(F.coalesce(F.try_element_at(cells, F.lit(5)), F.lit(""))).alias("roles"),
        )

    def visible(r):
        named = F.transform(F.split(r["roles"], ",", -1), lambda x: strip(x))
        open_row = (wanted == "") | (r["roles"] == "") | (r["roles"] == "all")
        return (r["href"] != "") & (open_row | F.exists(named, lambda x: F.contains(wanted, x)))

    rows = F.filter(F.transform(split_lines(block), row), visible)
    paths = F.transform(rows, lambda r: F.concat(F.lit("docs/decisions/"), r["href"]))
    return F.coalesce(paths, F.array().cast("array<string>"))


def decision_summary(text: Column | str, path: Column | str) -> Column:
    """Title, source and Summary section of a decision; the whole text without a Summary."""
    text, path = col(text), col(path)
    body = F.try_element_at(
        F.regexp_extract_all(text, F.lit(r"(?isU)##\s+Summary\s*\n(.*?)(?=\n##|\z)"), 1), F.lit(1)
    )
    title = F.try_element_at(
        F.regexp_extract_all(text, F.lit(r"(?U)\A#\s+([^\n]+)"), 1), F.lit(1)
    )
    summary = F.concat(
        F.lit("# "), F.coalesce(strip(title), path),
        F.lit("\n**Source:** `"), path, F.lit("`\n\n"), strip(body),
    )
    return F.when(body.isNotNull(), summary).otherwise(text)


def front_matter(text: Column | str) -> Column:
    """Flat ``key: value`` lines of the leading metadata block as a map, null without a block."""
    body = F.try_element_at(
        F.regexp_extract_all(
            F.replace(col(text), F.lit("\r\n"), F.lit("\n")), F.lit(r"(?s)\A---\n(.+?)\n---"), 1
        ),
        F.lit(1),
    )
    return flat_mapping(body)


def flat_mapping(block: Column) -> Column:
    """``key: value`` lines as a map; quotes around a value are dropped, a repeated key keeps the last."""
    pairs = F.filter(
        F.transform(
            F.split(block, "\n", -1),
            lambda line: F.struct(
                strip(F.regexp_extract(line, r"^([A-Za-z_][\w ]*?)\s*:(.*)$", 1)).alias("key"),
                F.regexp_replace(
                    strip(F.regexp_extract(line, r"^([A-Za-z_][\w ]*?)\s*:(.*)$", 2)),
                    r"""^(['"])(.*)\1$""", "$2",
                ).alias("value"),
            ),
        ),
        lambda p: p["key"] != "",
    )
    last = let(
        pairs,
        lambda ps: F.filter(
            ps,
            lambda p, i: ~F.exists(
                F.slice(ps, i + 2, F.greatest(F.size(ps) - i - 1, F.lit(0))),
                lambda later: later["key"] == p["key"],
            ),
        ),
    )
    return F.map_from_entries(last)


def flow_list(value: Column) -> Column:
    """``[a, b]`` as an array; anything that is not an inline list gives an empty array."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    items = F.transform(
        F.split(inner, ",", -1), lambda x: F.regexp_replace(strip(x), r"""^(['"])(.*)\1$""", "$2")
    )
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def skill_stub(text: Column | str, path: Column | str) -> Column:
    """Listing entry of a skill document: title and path, then description, triggers and scope."""
    path = col(path)
    meta = front_matter(text)
    bare = F.concat(F.lit("- ["), path, F.lit("]"))

    def entry(m):
        triggers = F.array_join(flow_list(F.element_at(m, "triggers")), ", ")
        described = F.element_at(m, "description")
        scope = F.element_at(m, "scope")
        return F.concat_ws(
            "\n",
            F.concat(F.lit("- "), F.coalesce(F.element_at(m, "title"), path), F.lit(" ["), path, F.lit("]")),
            F.when(described != "", F.concat(F.lit("  "), described)),
            F.when(triggers != "", F.concat(F.lit("  Triggers: "), triggers)),
            F.when(scope != "", F.concat(F.lit("  Scope: "), scope)),
        )

    return let(meta, lambda m: F.when(F.size(m) > 0, entry(m)).otherwise(bare))


def key_number(key: Column | str) -> Column:
    """First run of digits of a key as a number, 0 without one."""
    return F.coalesce(
        F.regexp_extract(F.coalesce(col(key), F.lit("")), r"([0-9]+)", 1).try_cast("long"), F.lit(0)
    ).cast("long")


def snippet(text: Column | str, chars: int = 300) -> Column:
    """Opening of a document on one line, as shown beside a whole-document hit."""
    head = collapse_spaces(F.substring(col(text), 1, chars))
    return F.when(
        head != "", F.concat(F.lit("[Semantic Match] "), head, F.lit("..."))
    ).otherwise(F.lit("[Semantic vector match in file] (Read file for details)"))
