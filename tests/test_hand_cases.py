"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from memlake.functions import chunking, keywords, markdown, paths, rules, text
from memlake.operators import backlog, code, edits, index, reading, retrieval, versions
from memlake.streaming import changes, ledger


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- chunking --------------------------------------------------------------------------------

def test_header_chunks_carry_the_breadcrumb(one):
    doc = "# Harbour\nTides first.\n\n## Moorings\nEast wall.\nWest wall.\n### Winter berths\nClosed.\n"
    got = [(c.section, c.start_line, c.end_line) for c in one(doc, chunking.header_chunks)]
    assert got == [("# Harbour > ## Moorings", 4, 6), ("# Harbour > ## Moorings > ### Winter berths", 7, 8)]


def test_orphan_heading_hangs_under_the_title(one):
    (chunk,) = one("# Orchard\nRows.\n### Late pears\nPick in October.\n", chunking.header_chunks)
    assert chunk.section == "# Orchard > ### Late pears"


def test_second_title_restarts_the_trail(one):
    doc = "# A\n## B\nx\n# C\ny\n### D\nz"
    got = [(c.section, c.text.endswith("y")) for c in one(doc, chunking.header_chunks)]
    assert got == [("# A > ## B", True), ("# C > ### D", False)]


def test_title_only_is_one_window(one):
    (chunk,) = one("# Ledger\nNothing below carries a heading.\n", chunking.header_chunks)
    assert (chunk.section, chunk.start_line, chunk.end_line) == ("chunk_1", 1, 3)


def test_windows_snap_to_spaces_and_overlap(one):
    doc = " ".join(c * 50 for c in "ABC")
    got = [c.text for c in one(doc, lambda c: chunking.overlap_chunks(c, 60, 0.15))]
    assert got == [doc[0:50], doc[41:101], doc[92:152]]


@pytest.mark.parametrize("blank", ["", " \n\t "])
def test_blank_text_has_no_chunks(one, blank):
    assert one(blank, chunking.overlap_chunks) == []
    assert one(blank, chunking.header_chunks) == []


def _windows(doc, size, pct):
    """Plain restatement of the window rule."""
    out, pos, shared = [], 0, int(size * pct)
    while True:
        raw = min(pos + size, len(doc))
        end = raw
        if raw < len(doc):
            tail = doc[max(0, raw - 40) : raw]
            at = max(tail.rfind(" "), -1)
            at = tail.rfind("\n") if at < 0 else at
            end = raw if at < 0 else max(0, raw - 40) + at
        out.append((doc[pos:end], doc[:pos].count("\n") + 1, doc[:end].count("\n") + 1))
        if end >= len(doc):
            return out
        pos = max(end - shared, pos + 1)


@pytest.mark.parametrize("unit", ["word ", "ab\n", "x", "é日 𝄞\n", "longer-than-forty-characters-without-any-break|"])
def test_windows_of_long_texts(one, unit):
    doc = unit * (9000 // len(unit))
    got = [(c.text, c.start_line, c.end_line) for c in one(doc, lambda c: chunking.overlap_chunks(c, 500, 0.2))]
    assert got == _windows(doc, 500, 0.2)


@pytest.mark.parametrize(
    "doc, expected",
    [
        ("```\nouter\n```python\ninner\n```\n```", [(0, 4)]),
        ("~~~\na\n```\n~~~", [(0, 3)]),
        ("```\nnever closed", []),
        ("````\n```\n````", [(0, 2)]),
        (" ```\nindented\n```", []),
        ("plain", []),
    ],
)
def test_fences(one, doc, expected):
    assert [tuple(r) for r in one(doc, lambda c: markdown.fence_ranges(F.split(c, "\n", -1)))] == expected


# --- keywords --------------------------------------------------------------------------------

@pytest.mark.parametrize(
    "doc, expected",
    [
        ("Crate K77 holds doi:10.55/x7 and two OpenReel spools, as Q12 says",
         ["k77", "q12", "doi:10.55/x7", "openreel"]),
        ("the NBC desk rang TUV twice", ["nbc", "tuv"]),
        ("QWERTYUIOP stays out", []),
        ("this MUST never be ONLY that", []),
        ("see docs/ab.md, 12-34-56 and (Straße9) straSSe9", ["strasse9", "docs/ab.md", "12-34-56"]),
        ("x" * 64 + "1 " + "y" * 62 + "Z1", ["y" * 62 + "z1"]),
    ],
)
def test_identifier_terms(one, doc, expected):
    assert one(doc, keywords.identifier_terms) == expected


def test_keyword_budget(one):
    got = one(" ".join(f"ID{i}" for i in range(25)), lambda c: keywords.extract_keywords(F.lit(""), c))
    assert got.kept == [f"id{i}" for i in range(20)] and len(got.dropped) == 5


def test_a_term_over_the_byte_budget_makes_room_for_later_ones(one):
    terms = [f"{'a' * 59}{i:02d}" for i in range(9)] + ["b1"]
    got = one(" ".join(terms), lambda c: keywords.extract_keywords(F.lit(""), c))
    assert got.kept == terms[:8] + ["b1"] and got.dropped == [terms[8]]


def test_stub_has_no_keywords(one):
    assert one("F1 F2", lambda c: keywords.extract_keywords(F.lit(""), c)).kept == []


def test_chunk_body_drops_trail_and_heading(one):
    assert one("# A > ## B\n## B\nbody", lambda c: keywords.chunk_body(F.lit("# A > ## B"), c)) == "body"
    assert one("window", lambda c: keywords.chunk_body(F.lit("chunk_1"), c)) == "window"


# --- text ------------------------------------------------------------------------------------

def test_clean(one):
    doc = "> **Version: 1**\n> | a |\n> | b |\nkeep <!-- a\nb -->this\n\n\n\nend\n"
    assert one(doc, text.clean) == "keep this\n\nend"


def test_render_is_one_pass(one):
    known = F.create_map(F.lit("X"), F.lit("{{y}}"), F.lit("Y"), F.lit("2"))
    assert one("{{x}} {{Y}} {{z}}", lambda c: text.render(c, known)) == "{{y}} 2 {{z}}"


DOC = "# T\n\n## A b\ntext\n### sub\nx\n## C\nend\n"


def test_section_edits(one):
    lit = F.lit
    edit = lambda f: one(DOC, lambda c: f(F.col(c)))
    assert edit(lambda c: markdown.section(c, lit("a  B"))) == "## A b\ntext\n### sub\nx"
    assert edit(lambda c: markdown.section(c, lit("nope"))) is None
    assert edit(lambda c: markdown.replace_section(c, lit("C"), lit("## C\nnew"), lit(2))).content == (
        "# T\n\n## A b\ntext\n### sub\nx\n\n## C\nnew\n"
    )
    assert edit(lambda c: markdown.delete_section(c, lit("A b"))).content == "# T\n\n## C\nend\n"
    assert edit(lambda c: markdown.append_section(c, lit("C"), lit("x"), lit(2))).error == "Section 'C' already exists."
    assert edit(lambda c: markdown.replace_chunk(c, lit(3), lit(4), lit("Z"))).content == "# T\n\nZ\n### sub\nx\n## C\nend\n"
    assert edit(lambda c: markdown.replace_chunk(c, lit(99), lit(99), lit("Z"))).error.startswith("Invalid start line")


@pytest.mark.parametrize(
    "old, error",
    [("text", None), ("nope", "Patch target string not found."),
     ("x", "Patch target string found 2 times. The match must be unique.")],
)
def test_patch(one, old, error):
    assert one(DOC, lambda c: markdown.patch(F.col(c), F.lit(old), F.lit("NEW"))).error == error


# --- paths and scopes ------------------------------------------------------------------------

@pytest.mark.parametrize("scope", ["maps/B7", "maps/5%_slope", "maps/l'isle"])
def test_scopes_are_literal_and_sibling_safe(spark, scope):
    df = spark.createDataFrame([(f"{scope}/a.md",), (f"{scope}0/a.md",), (scope,), ("maps/5x slope/a.md",)], "path string")
    assert rows(df.where(paths.under_any("path", [scope]))) == [(f"{scope}/a.md",)]
    table = spark.createDataFrame([(scope,)], "scope string")
    assert rows(retrieval.scope_filter(df, table)) == [(f"{scope}/a.md",)]


def test_too_many_scopes(one):
    many = F.array(*[F.lit(f"s{i}") for i in range(21)])
    assert one("", lambda c: paths.scope_error(many)).startswith("Too many scopes: 21")


# --- fusion ----------------------------------------------------------------------------------

def test_fusion_prefers_rows_of_both_lanes(spark):
    lane = lambda names: spark.createDataFrame(
        [(1, n, 1, 2, i + 1, n.upper()) for i, n in enumerate(names)],
        "qid int, path string, start_line int, end_line int, rank int, section string",
    )
    got = [(r.path, r.match) for r in retrieval.rrf(lane("ab"), lane("bc"), 5).orderBy("rank").collect()]
    assert got == [("b", "both"), ("a", "vector"), ("c", "keyword")]


# --- index and code --------------------------------------------------------------------------

def test_ghosts_leave_every_table(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    live = spark.createDataFrame([("a",)], "path string")
    kept, gone = index.prune_ghosts({"chunks": chunks, "keywords": chunks}, live)
    assert rows(kept["chunks"]) == rows(kept["keywords"]) == [("a", 1)] and rows(gone) == [("b",)]
    _, none = index.prune_ghosts({"chunks": chunks.limit(0)}, live)
    assert rows(none) == []


def test_duplicate_names_get_their_line(spark):
    units = spark.createDataFrame(
        [("p", "f.py", "method", "foo", 3, 0), ("p", "f.py", "method", "foo", 10, 1),
         ("p", "f.py", "method", "foo", 10, 2), ("p", "f.py", "class", "foo", 1, 3)],
        "project string, path string, chunk_type string, chunk_name string, start_line int, position int",
    )
    got = [r.chunk_name for r in code.dedupe_names(units).orderBy("position").collect()]
    assert got == ["foo", "foo_L10", "foo_L10_3", "foo"]


def test_outline_of_names_keeps_import_text(spark):
    units = spark.createDataFrame(
        [("p", "a/f.py", t, t, i, i, "text") for i, t in enumerate(["file", "class", "method", "imports"])],
        "project string, path string, chunk_type string, chunk_name string, start_line int, end_line int, skeleton_text string",
    )
    got = [(r.chunk_type, r.skeleton_text) for r in code.file_outline(units, "f.py", depth=1).collect()]
    assert got == [("file", None), ("class", None), ("imports", "text")]


# --- backlog ---------------------------------------------------------------------------------

TASK = "id long, key string, title string, status string, blocked_by array<string>, resolution string, updated timestamp"


def test_completing_a_blocker_frees_the_waiting_task(spark):
    tasks = spark.createDataFrame(
        [(1, "A", "a", "open", [], None, None), (2, "B", "b", "open", ["A"], None, None)], TASK
    )
    keys = spark.createDataFrame([("A",)], "key string")
    now = F.timestamp_micros(F.lit(0))
    after, report = backlog.complete_tasks(tasks, keys, "fixed", now)
    assert {r.key: (r.status, r.blocked_by) for r in after.collect()} == {"A": ("closed", []), "B": ("open", [])}
    unknown = keys.unionByName(spark.createDataFrame([("X",)], "key string"))
    after, report = backlog.complete_tasks(tasks, unknown, "fixed", now)
    assert {r.key: r.status for r in after.collect()} == {"A": "open", "B": "open"}
    assert {r.key: r.reason for r in report.collect()} == {"A": None, "X": "Task 'X' not found"}


@pytest.mark.parametrize("note, passes", [("ok", False), ("fixed", True)])
def test_status_change_needs_a_resolution(one, note, passes):
    reason = one(note, lambda c: rules.resolution_reason(F.lit("open"), F.lit("closed"), c))
    assert (reason is None) == passes


def test_ids_go_on_from_the_highest(spark):
    tasks = spark.createDataFrame([(41,)], "id long")
    new = spark.createDataFrame([(1, "F"), (2, "TD")], "seq int, type string")
    assert [r.key for r in backlog.assign_ids(new, tasks).orderBy("seq").collect()] == ["F42", "TD43"]
    assert backlog.next_id(tasks.limit(0)).first().next_id == 1


# --- edits and versions ----------------------------------------------------------------------

def test_edit_order(spark):
    batch = spark.createDataFrame(
        [(1, "a", "patch", None), (2, "a", "replace_chunk", 2), (3, "a", "replace_chunk", 9)],
        "seq int, path string, mode string, start_line int",
    )
    got = [r.seq for r in edits.order_edits(batch).orderBy("position").collect()]
    assert got == [3, 2, 1]


def test_log_takes_only_entries_at_its_top(spark):
    docs = spark.createDataFrame([("s/history.md", "old")], "path string, content string")
    batch = spark.createDataFrame(
        [(1, "s/history.md", "replace_file", "x", None), (2, "s/history.md", "patch", "new\n\nold", "old"),
         (3, "s/history.md", "patch", "mid", "old")],
        "seq int, path string, mode string, content string, old_str string",
    )
    out = edits.apply_edits(docs, batch, F.timestamp_micros(F.lit(0)))
    assert out.docs.first().content == "new\n\nold"
    assert [r.status for r in out.results.orderBy("seq").collect()] == ["error", "success", "error"]
    assert out.versions.first().content == "old"


def test_paged_reads(spark):
    docs = spark.createDataFrame([("a.md", "one\ntwo\nthree\n")], "path string, content string")
    asked = spark.createDataFrame(
        [(1, "a.md", "paged", 5, 2), (2, "a.md", "full", None, None), (3, "b.md", "full", None, None)],
        "rid int, path string, mode string, max_chars int, skip_chars int",
    )
    got = {r.rid: (r.text, r.error) for r in reading.read_docs(asked, docs).collect()}
    assert got[1][0] == (
        "[Text truncated: 2 characters skipped at the beginning]\n... e\ntwo\n... [Text truncated: limit 5 characters exceeded]"
    )
    assert got[2] == ("one\ntwo\nthree", None) and got[3] == (None, "File not found: b.md")


def test_retention_keeps_the_only_version(spark):
    hist = spark.sql(
        "SELECT path, timestamp_seconds(t) AS version_ts, 'x' AS content FROM VALUES ('a', 0), ('a', 3600), ('b', 0), ('c', 90000) AS v(path, t)"
    )
    kept = versions.retain(hist, 2, F.timestamp_seconds(F.lit(90000)))
    assert rows(kept.select("path", F.unix_seconds("version_ts"))) == [("a", 3600), ("b", 0), ("c", 90000)]


# --- change events and ledger ----------------------------------------------------------------

def test_bursts_one_gap_apart_belong_together(spark):
    events = spark.sql("SELECT 'x' AS path, timestamp_seconds(t) AS ts FROM VALUES (0), (7), (20) AS v(t)")
    got = changes.debounce(events, 7).select(F.unix_seconds("last_ts"), "n")
    assert rows(got) == [(7, 2), (20, 1)]


def test_move_out_of_scope_is_a_delete(spark):
    events = spark.createDataFrame(
        [("moved", "a.py", "b.txt", False), ("modified", "d.py", None, True)],
        "event_type string, src_path string, dest_path string, is_directory boolean",
    )
    assert rows(changes.route_events(events, [".py"])) == [("delete", "a.py")]


def test_ledger(spark):
    attempts = spark.createDataFrame(
        [(1, 1, 500), (1, 2, 200), (2, 1, 404), (2, 2, 200), (3, 1, 503), (4, 1, None)], "op_id long, t int, http_code int"
    ).withColumn("attempt_ts", F.timestamp_seconds("t"))
    got = {r.op_id: r.status for r in ledger.attempt_state(attempts).collect()}
    assert got == {1: "done", 2: "failed", 3: "pending", 4: "pending"}


# --- contradictions and ties -----------------------------------------------------------------

def test_several_patches_of_one_task_are_refused(spark):
    tasks = spark.createDataFrame([("F1", "open", "a", None), ("F2", "open", "b", None)], "key string, status string, title string, updated timestamp")
    patches = spark.createDataFrame([("F1", "x"), ("F1", "y"), ("F2", "z")], "key string, title string")
    new, report = backlog.update_tasks(tasks, patches, F.current_timestamp())
    assert rows(new.select("key", "title")) == [("F1", "a"), ("F2", "z")]
    assert sorted((r["key"], r["reason"] is None) for r in report.collect()) == [("F1", False), ("F1", False), ("F2", True)]


def test_one_of_several_renames_is_taken(spark):
    table = spark.createDataFrame([("old.md", 1), ("stay.md", 2)], "path string, n int")
    moves = spark.createDataFrame([("old.md", "b.md"), ("old.md", "a.md"), ("gone.md", "c.md")], "old_path string, new_path string")
    moved, rest = index.rename_paths(table, moves)
    assert rows(moved) == [("a.md", 1), ("stay.md", 2)]
    assert rows(rest) == [("gone.md", "c.md"), ("old.md", "b.md")]


def test_versions_of_one_time_have_an_order(spark):
    hist = spark.sql("SELECT 'p.md' AS path, timestamp'2024-05-01 10:00:00' AS version_ts, c AS content FROM VALUES ('x'), ('yy') t(c)")
    for some in (hist, hist.orderBy("content"), hist.orderBy(F.desc("content"))):
        assert versions.latest_versions(some).first()["content"] == "yy"
        assert [r["size"] for r in versions.versions(some).orderBy("rank").collect()] == [2, 1]


def test_unknown_actions_fail_their_build(spark):
    from memlake.plans import assemble

    steps = spark.createDataFrame(
        [("p", "good", 1, "append_text", "hi"), ("p", "bad", 1, "append_text", "hi"), ("p", "bad", 2, "polish", "x")],
        "project string, build string, step int, action string, content string")
    docs = spark.createDataFrame([], "project string, path string, content string")
    got = {r["build"]: (r["content"], r["error"]) for r in assemble.assemble(steps, docs, "2024-05-01").collect()}
    assert got == {"good": ("hi", None), "bad": (None, "Unknown pipeline action: 'polish'")}


def test_a_single_blocker_becomes_a_list(spark):
    new = spark.createDataFrame(
        [(1, "F", "t1", "p", "s", None, None, " F7 "), (2, "F", "t2", "p", "s", None, None, None)],
        "seq int, type string, title string, problem string, solution string, status string, priority string, blocked_by string")
    tasks = spark.createDataFrame([(7, "F7", "other")], "id long, key string, title string")
    accepted, _ = backlog.add_tasks(new, tasks, "p", F.current_timestamp())
    assert {r["title"]: r["blocked_by"] for r in accepted.collect()} == {"t1": ["F7"], "t2": []}


def test_two_documents_never_become_one(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, v int")
    moves = spark.createDataFrame([("b", "c"), ("a", "c"), ("d", "e")], "old_path string, new_path string")
    moved, rest = index.rename_paths(table, moves)
    assert sorted(map(tuple, moved.collect())) == [("c", 1), ("e", 4)]
    assert [tuple(r) for r in rest.collect()] == [("b", "c")]


def test_a_failing_check_fails_its_build(spark):
    from memlake.plans import assemble

    docs = spark.createDataFrame([("p", "v.md", "# V\nversion: 1.2\n")], "project string, path string, content string")
    step = lambda build, n, action, **more: {"project": "p", "build": build, "version": "1", "step": n, "action": action, **more}
    steps = [
        *[step(b, 0, "append_text", content="text") for b in ("good", "bad", "lost", "bare")],
        step("good", 1, "validate", path="v.md", regex=r"version: (\S+)", expected=" 1.2 "),
        step("good", 2, "append_text", content="more"),
        step("bad", 1, "validate", path="v.md", regex=r"version: (\S+)", expected="1.3", section_name="V"),
        step("lost", 1, "validate", path="none.md", regex="x", expected="x"),
        step("bare", 1, "validate", path="v.md", regex="x"),
    ]
    fields = "project string, build string, version string, step int, action string, path string, content string, regex string, expected string, section_name string"
    names = [f.split()[0] for f in fields.split(", ")]
    manifests = spark.createDataFrame([tuple(s.get(n) for n in names) for s in steps], fields)
    built = {r["build"]: (r["content"], r["error"]) for r in assemble.assemble(manifests, docs, "2024-01-31").collect()}
    assert built == {
        "good": ("text\nmore", None), "bad": (None, "Validation failed for v.md. Expected '1.3', but got '1.2'"),
        "lost": (None, "Validation source file not found: none.md"),
        "bare": (None, "Action 'validate' requires 'path', 'regex', and 'expected'"),
    }
