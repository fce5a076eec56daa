"""Path expressions: canonical form, scopes, ancestors, routing and test-file flags."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.exprs import col, strip

# Fixed value: most directories one search may be limited to.
MAX_SCOPES = 20

# Directories a source scan never enters.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__",
    ".pytest_cache", ".mypy_cache", "bin", "obj", "dist", "build", ".next", "out",
)


def canonical_path(path: Column | str) -> Column:
    """Lower-case path without leading './' or '/'."""
    return F.lower(F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", ""))


def normalize_scope(scope: Column | str) -> Column:
    """Trim, turn backslashes round, drop trailing slashes."""
    return F.regexp_replace(F.replace(strip(col(scope)), F.lit("\\"), F.lit("/")), r"/+\z", "")


def normalize_scopes(scopes: Column | str) -> Column:
    return F.transform(col(scopes), normalize_scope)


def scope_error(scopes: Column | str, limit: int = MAX_SCOPES) -> Column:
    """Why an array of normalised scopes is not acceptable, null when it is."""
    scopes = col(scopes)
    bad = F.filter(
        scopes, lambda s: s.startswith("/") | s.rlike(r"^[A-Za-z]:") | s.rlike(r"(^|/)\.\.(/|$)")
    )
    return (
        F.when(
            F.size(scopes) > limit,
            F.format_string(f"Too many scopes: %d supplied, maximum is {limit}.", F.size(scopes)),
        )
        .when(F.exists(scopes, lambda s: s == ""), F.lit("Scope must not be empty."))
        .when(
            F.size(bad) > 0,
            F.format_string(
                "Invalid scope: '%s'. Scopes must be directories inside the project's artifacts folder.",
                F.get(bad, F.lit(0)),
            ),
        )
    )


def under_any(path: Column | str, scopes: Sequence[str]) -> Column:
    """Path strictly below one of a few literal directories; no wildcard has a meaning."""
    path = col(path)
    out = F.lit(False)
    for scope in scopes:
        out = out | path.startswith(scope + "/")
    return out


def under_scopes(path: Column | str, scopes: Column | str) -> Column:
    """Same test against an array column of directories."""
    path = col(path)
    return F.exists(col(scopes), lambda s: F.startswith(path, F.concat(s, F.lit("/"))))


def ancestors(path: Column | str) -> Column:
    """All directories above a path: 'a/b/c.md' gives ['a', 'a/b']."""
    path = col(path)
    parts = F.split(path, "/", -1)
    deep = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(
        F.size(parts) > 1, F.transform(deep, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ).otherwise(F.array().cast("array<string>"))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def has_extension(path: Column | str, exts: Sequence[str]) -> Column:
    return extension(path).isin(*[e.lower() for e in exts])


def hidden(path: Column | str) -> Column:
    """A segment of the path starts with a dot."""
    return col(path).rlike(r"(^|/)\.[^/]")


def in_skipped_dir(path: Column | str, names: Sequence[str] = SKIP_DIRS) -> Column:
    """A directory above the file is on the skip list."""
    any_name = "|".join(re.escape(n) for n in names)
    return col(path).rlike(rf"(^|/)(?:{any_name})/")


def is_test(path: Column | str) -> Column:
    return F.lower(col(path)).rlike(r"tests/|test_")


def relative_to(path: Column, root: str) -> Column:
    """Part of a file URI or path below ``root``."""
    clean = re.sub(r"^file:/*", "/", root.rstrip("/")) + "/"
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    at = F.instr(plain, clean)
    return F.when(at > 0, F.substring(plain, at + len(clean), F.length(plain))).otherwise(plain)


def route_dir(status: Column | str) -> Column:
    """Folder of a task document: done, paused or active."""
    status = F.lower(col(status))
    return (
        F.when(status.isin("closed", "done"), F.lit("done"))
        .when(status.contains("paused"), F.lit("paused"))
        .otherwise(F.lit("active"))
    )


def route_path(key: Column | str, status: Column | str, year: Column | str) -> Column:
    """Relative path of a task document; finished tasks are kept by year."""
    folder = route_dir(status)
    return F.when(
        folder == "done", F.concat_ws("/", folder, col(year).cast("string"), F.concat(col(key), F.lit(".md")))
    ).otherwise(F.concat_ws("/", folder, F.concat(col(key), F.lit(".md"))))
