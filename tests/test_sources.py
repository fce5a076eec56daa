"""Scans, bucketed tables, registries and streams on small files."""

import datetime
import glob
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from memlake.functions import embedding
from memlake.plans import indexing, registry
from memlake.session import cut_lineage, scratch_path, scratch_root
from memlake.sources.buckets import bucket_of, read_table, replace_paths, start_table
from memlake.sources.corpus import MAX_SOURCE_BYTES, list_files, scan_changed, scan_code, scan_code_rejects, scan_corpus
from memlake.streaming import changes, ledger


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.md": b"\xef\xbb\xbf# A", "sub/b.TXT": b"b", "sub/c.py": b"print(1)", ".hid/d.md": b"d", "backlog_x.md": b"x",
        "node_modules/e.py": b"e", "src/f.py": b"\x00\x01", "src/g.py": b"pad" + b" " * (3 * 1024 * 1024), "src/h i+j.py": b"h",
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(tmp_path)


def test_scan_corpus(spark, tree):
    got = {r.path: r.content for r in scan_corpus(spark, tree).collect()}
    assert got == {"a.md": "# A", "sub/b.TXT": "b"}


def test_scan_code(spark, tree):
    got = {r.path: r.content for r in scan_code(spark, tree, [".py"], MAX_SOURCE_BYTES).collect()}
    assert got == {"sub/c.py": "print(1)", "src/h i+j.py": "h"}


def test_large_files_are_not_opened(spark, tree):
    found = scan_code(spark, tree, [".py"], MAX_SOURCE_BYTES)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,3145728)" in text.split("PushedFilters: [")[1].split("]")[0]
    listed = list_files(spark, tree, [".py"])
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert {r.path for r in listed.collect()} == {"sub/c.py", "src/f.py", "src/g.py", "src/h i+j.py"}


def test_scans_since_a_time(spark, tree):
    os.utime(f"{tree}/a.md", (1_000_000, 1_000_000))
    os.utime(f"{tree}/sub/c.py", (1_000_000, 1_000_000))
    assert {r.path for r in scan_corpus(spark, tree, since="2000-01-01T00:00:00").collect()} == {"sub/b.TXT"}
    assert {r.path for r in scan_code(spark, tree, [".py"], 1000, since="2000-01-01T00:00:00").collect()} == {"src/h i+j.py"}


def test_scan_of_what_changed(spark, tree):
    known = cut_lineage(list_files(spark, tree, [".md", ".txt"]))
    assert scan_changed(spark, tree, known, [".md", ".txt"]).count() == 0
    os.remove(f"{tree}/a.md")
    for name, body in (("sub/b.TXT", "longer"), ("n.md", "new")):
        with open(f"{tree}/{name}", "w") as out:
            out.write(body)
    got = {(r.path, r.state, r.content) for r in scan_changed(spark, tree, known, [".md", ".txt"]).collect()}
    assert got == {("a.md", "vanished", None), ("sub/b.TXT", "changed", "longer"), ("n.md", "new", "new")}
    assert scan_changed(spark, tree, known.limit(0), [".md", ".txt"]).count() == 3


class _Session:
    """A session with a given setting and master."""

    def __init__(self, value, master):
        self.conf = self
        self.sparkContext = self
        self.value, self.master, self.applicationId = value, master, f"{value}-{master}"

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_scratch_folder_comes_from_the_session():
    assert scratch_root(_Session("s3a://shared/ck", "yarn")) == "s3a://shared/ck"
    local = _Session(None, "local[2]")
    assert scratch_root(local) == scratch_root(local)
    with pytest.raises(RuntimeError):
        scratch_root(_Session(None, "yarn"))


def test_registries(spark):
    registry.register_chunker(".csv", lambda text, size, overlap: F.array(F.struct(
        F.lit("row").alias("section"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.upper(text).alias("text"))))
    docs = spark.createDataFrame([("t.CSV", "a,b"), ("u.md", "# T\n## H\nF1 x y")], "path string, content string")
    try:
        got = {r.path: r.section for r in indexing.chunk_documents(docs).collect()}
        assert got == {"t.CSV": "row", "u.md": "# T > ## H"}
    finally:
        registry.CHUNKERS.pop(".csv")
    embedding.register_encoder("length", lambda: lambda text: F.array(F.length(text).cast("float")))
    vectors = embedding.embed(docs, "content", encode="length")
    assert {r.path: list(r.vector) for r in vectors.collect()}["t.CSV"] == [3.0]
    with pytest.raises(ValueError):
        embedding.encoder("nope")


def test_refresh_touches_only_changed_documents(spark):
    docs = spark.createDataFrame([("a.md", "# A\n## B\nuse F1 now please"), ("b.md", "plain F2 text here")], "path string, content string")
    old = indexing.build_index(docs)
    newer = docs.withColumn("content", F.when(F.col("path") == "b.md", "now F3 and more").otherwise("lost"))
    changed = spark.createDataFrame([("b.md",)], "path string")
    new = indexing.refresh_index(old, newer, changed)
    assert {(r.path, r.keywords) for r in new.keywords.collect()} == {("a.md", "f1"), ("b.md", "f3")}
    assert new.documents.count() == 2 and new.chunks.count() == 2


def _write_events(spark, root, batches):
    for i, batch in enumerate(batches):
        rows = [(p, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for p, s in batch]
        spark.createDataFrame(rows, "path string, ts timestamp_ntz").coalesce(1).write.parquet(f"{root}/e={i}")


def test_stream_drops_events_older_than_the_watermark(spark):
    root, out = scratch_path(spark, "events"), scratch_path(spark, "bursts")
    _write_events(spark, root, [[("x", 0), ("x", 5)], [("y", 20000)], [("z", 40000)], [("x", 3), ("z", 80000)]])
    stream = (
        spark.readStream.schema("path string, ts timestamp_ntz, e int").option("maxFilesPerTrigger", 1).parquet(root)
    )
    bursts = changes.debounce(stream.select("path", "ts"), 7)
    writer = bursts.writeStream.outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", scratch_path(spark, "state")).format("parquet").start(out).awaitTermination()
    got = sorted((r.path, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("x", 2), ("y", 1), ("z", 1)]


def test_ledger_stream_matches_the_table(spark):
    root, out = scratch_path(spark, "attempts"), scratch_path(spark, "ledger")
    data = [[(1, 1, 500), (2, 1, 404)], [(1, 2, 200), (2, 2, 200), (3, 1, 503)]]
    for i, batch in enumerate(data):
        df = spark.createDataFrame(batch, "op_id long, t int, http_code int").withColumn("attempt_ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.parquet(f"{root}/b={i}")
    table = spark.read.parquet(root)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(root)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    writer = ledger.ledger_stream(stream, retry_seconds=None).writeStream.outputMode("update").foreachBatch(keep)
    writer.option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("op_id").agg(F.max_by("status", "batch").alias("s"))
    plain = ledger.attempt_state(table)
    assert sorted(map(tuple, last.collect())) == sorted((r.op_id, r.status) for r in plain.collect())


def test_a_change_writes_the_buckets_of_its_paths_only(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, v int")
    state = lambda: sorted((tuple(r) for r in read_table(spark, root).collect()), key=str)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{root}/bucket=*/*.parquet")}
    root = scratch_path(spark, "buckets")
    first = [(f"p{i % 40}", i) for i in range(200)] + [(None, 9)]
    start_table(frame(first), root, buckets=16)
    assert state() == sorted(first, key=str)
    before = files()
    # One path replaced, one emptied, one new; a row of a path that is not touched doesn't count.
    fresh, touched = frame([("p1", 1000), ("new", 7), ("p9", -1)]), frame([("p1", 0), ("p2", 0), ("new", 0)])
    expected = [r for r in first if r[0] not in ("p1", "p2")] + [("p1", 1000), ("new", 7)]
    for _ in range(2):
        replace_paths(fresh, touched, root, buckets=16)
        assert state() == sorted(expected, key=str)
    mine = {r[0] for r in touched.select(bucket_of(["path"], 16)).collect()}
    same = {f for f, t in files().items() if before.get(f) == t}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in same} == set(range(16)) - mine
    replace_paths(frame([]), frame(first), root, buckets=16)
    assert state() == [("new", 7), (None, 9)]
    replace_paths(frame([("a", 1)]), frame([]), root, buckets=16)
    assert len(state()) == 2


def test_settled_operations_leave_the_state(spark):
    root, state = scratch_path(spark, "attempts"), scratch_path(spark, "ledger-state")
    # Operations 0 to 9 are settled by their last answer, 10 to 14 stay pending; a late attempt moves the time on.
    data = [[(op, 1, 500) for op in range(15)], [(op, 60, 200 if op % 2 else 404) for op in range(10)], [(99, 100_000, 500)], [(98, 100_001, 500)]]
    for i, batch in enumerate(data):
        df = spark.createDataFrame(batch, "op_id long, t int, http_code int").withColumn("attempt_ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.parquet(f"{root}/b={i}")
    stream = spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", 1).parquet(root)
    writer = ledger.ledger_stream(stream, retry_seconds=None, settled_seconds=3600).writeStream.outputMode("update")
    writer.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    held = lambda name: spark.read.format("statestore").option("path", state).option("stateVarName", name).load()
    assert sorted(r[0] for r in held("open").select("key.op_id").collect()) == [10, 11, 12, 13, 14, 98, 99]
    assert held("settled").count() == 0


class _Told:
    """State and timers of one operation that count the messages sent to them."""

    def __init__(self):
        self.values, self.timers, self.sent = {}, [], 0

    def getValueState(self, name, schema, ttl=None):
        return SimpleNamespace(
            exists=lambda: self._send() or name in self.values, get=lambda: self._send() or self.values.get(name),
            update=lambda v: self._send() or self.values.update({name: v}), clear=lambda: self._send() or self.values.pop(name, None))

    def listTimers(self):
        self._send()
        return iter(list(self.timers))

    def registerTimer(self, at):
        self._send()
        self.timers.append(at)

    def deleteTimer(self, at):
        self._send()
        self.timers.remove(at)

    def _send(self):
        self.sent += 1


def test_an_operation_sends_few_messages_to_its_state():
    told = _Told()
    tracker = ledger._Delivery(None, 1000)
    tracker.init(told)
    row = lambda at, outcome: Row(op_id=7, outcome=outcome, at_us=at)

    def step(*rows):
        told.sent = 0
        (got,) = tracker.handleInputRows((7,), iter(rows), None)
        return got.status, got.attempts, told.sent

    assert step(*[row(i, "pending") for i in range(50)]) == ("pending", 50, 3)
    # Of many answers the first one stands; a settled operation leaves no count of a pending one.
    assert step(row(90_000, "failed"), row(70_000, "done"), row(80_000, "failed"), row(None, "failed")) == ("done", 54, 5)
    assert told.values == {"settled": ("done", 54, 70_000, 90_000)} and told.timers == [90]
    # A late earlier answer takes its place, and the timer moves.
    assert step(row(60_000, "failed"), row(99_000, "done"))[:2] == ("failed", 56)
    assert told.values == {"settled": ("failed", 56, 60_000, 99_000)} and told.timers == [99]


def test_pending_operations_are_due_again(spark):
    root, state, out = (scratch_path(spark, name) for name in ("attempts", "ledger-state", "ledger"))
    df = spark.createDataFrame([(1, 1, 500), (2, 1, 200)], "op_id long, t int, http_code int")
    df.withColumn("attempt_ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{root}/b=0")
    stream = spark.readStream.schema(spark.read.parquet(root).schema).parquet(root)
    seen = []

    def keep(batch, batch_id):
        seen.extend(tuple(r) for r in batch.collect())

    running = ledger.ledger_stream(stream, retry_seconds=1).writeStream.outputMode("update").foreachBatch(keep)
    running = running.option("checkpointLocation", state).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if sum(r == (1, "retry", 1) for r in seen) >= 2:
                break
            time.sleep(1)
    finally:
        running.stop()
    assert {(1, "pending", 1), (2, "done", 1), (1, "retry", 1)} == set(seen) and seen.count((1, "retry", 1)) >= 2


def test_scan_code_names_what_it_leaves_out(spark):
    root = scratch_path(spark, "sources")
    os.makedirs(root)
    for name, body in (("one.py", b"x = 1\n"), ("bin.py", b"a\0b"), ("wide.py", b"#" * 5000)):
        with open(f"{root}/{name}", "wb") as out:
            out.write(body)
    assert {r.path for r in scan_code(spark, root, [".py"]).collect()} == {"one.py", "wide.py"}
    got = {(r.path, r.reason) for r in scan_code_rejects(spark, root, [".py"], max_bytes=4000).collect()}
    assert got == {("bin.py", "binary"), ("wide.py", "too large")}


def test_files_of_a_small_table_are_written_by_many_tasks(spark, tmp_path):
    """A pages table of one file is dealt out, and a page that comes twice is still one file."""
    from memlake.catalog.history import _page_files

    pages = [(i // 2 if i < 4 else i, "http://a/b", f'<html lang="en">{i // 2 if i < 4 else i}') for i in range(60)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    found = scan_code(spark, _page_files(spark, str(tmp_path), "small"), [".txt"]).collect()
    assert len(found) == 58 and len({r.path.split("part-")[1][:5] for r in found}) > 3
    assert sorted(r.content.count("<html") for r in found)[-3:] == [1, 2, 2]


def test_many_small_files_are_scanned_by_few_tasks(spark, tmp_path):
    """Spark gives each of these files a task of its own, and lists their folders by as many tasks as there are folders."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(150):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.txt").write_bytes(b"\0" if i == 7 else f"text {i}".encode())
    root, before, most = str(tmp_path), spark.conf.get(tasks, None), 4 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        known = cut_lineage(list_files(spark, root, [".txt"]))
        assert known.rdd.getNumPartitions() <= most and known.count() == 150
        for found, rows in ((scan_code(spark, root, [".txt"]), 149), (scan_corpus(spark, root, [".txt"]), 150),
                            (scan_code_rejects(spark, root, [".txt"]), 1), (scan_code_rejects(spark, root, [".txt"], 6), 141)):
            assert found.rdd.getNumPartitions() <= 2 * most and found.count() == rows
        assert scan_changed(spark, root, known.limit(0), [".txt"]).count() == 150
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get(tasks, None) == before


def test_page_files_hold_the_rows_of_their_page(spark, tmp_path):
    """Null pages and texts, pages of several rows and of several tasks, as Spark's text writer lays them out; no checksums."""
    from memlake.catalog.history import _page_files

    html = lambda i, lang: f'<html lang="{lang}">ä {i}\nmore'
    pages = [(1, html(0, "de")), (1, html(1, "de")), (1, html(2, "en")), (2, None), (None, html(3, "de")), (None, None), (-3, "none"), (4, "")]
    data = str(tmp_path / "pages.parquet")
    for part in range(9):
        rows = pages if part == 0 else [(1, html(part + 10, "de"))]
        spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.mode("append").parquet(data)
    root = _page_files(spark, str(tmp_path), "pages").removeprefix("file://")
    got = {}
    for at in glob.glob(f"{root}/**/*", recursive=True, include_hidden=True):
        if os.path.isfile(at) and "part-" in at:
            assert at.endswith(".txt") and at.count("part-") == 1
            with open(at, encoding="utf-8", newline="") as file:
                got.setdefault(os.path.dirname(at)[len(root) + 1:], []).append(file.read())
    none = "__HIVE_DEFAULT_PARTITION__"
    text = got.pop("lang=de/page=1")
    assert len(text) > 1 and sorted("".join(text)) == sorted("".join(html(i, "de") + "\n" for i in (0, 1, *range(11, 19))))
    assert got == {
        "lang=en/page=1": [html(2, "en") + "\n"], f"lang={none}/page=2": ["\n"], f"lang=de/page={none}": [html(3, "de") + "\n"],
        f"lang={none}/page={none}": ["\n"], f"lang={none}/page=-3": ["none\n"], f"lang={none}/page=4": ["\n"],
    }
