"""Backlog operators: search, lookup, new tasks, updates, batch close and unblocking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules
from memlake.functions.exprs import is_blank, strip
from memlake.operators.skew import broadcast_if_small, salted_join, split_rank

SUMMARY = ("key", "title", "status", "priority", "project")


def search_tasks(
    tasks: DataFrame, status: str | None = "open", priority: str | None = None,
    type_: str | None = None, project: str | None = None,
) -> DataFrame:
    """Tasks that meet every given condition, as summaries in id order."""
    wanted = {"status": status, "priority": priority, "type": type_, "project": project}
    for name, value in wanted.items():
        if value is not None:
            tasks = tasks.where(F.col(name) == value)
    return tasks.orderBy("id").select(F.col("key").alias("id"), "title", "status", "priority", "project")


def get_task(tasks: DataFrame, id: int | None = None, key: str | None = None) -> DataFrame:
    return tasks.where(F.col("id") == id) if id is not None else tasks.where(F.col("key") == key)


def task_details(keys: DataFrame, tasks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Index row and body per requested key; an unknown key or a missing body is an error row."""
    head = tasks.select("key", "title", "type", "status", "priority", "project", "file_path",
                        F.lit(True).alias("_known"))
    text = [c for c in bodies.columns if c in ("problem", "solution", "comments", "resolution")]
    body = bodies.select("file_path", *text, F.lit(True).alias("_body"))
    asked = keys.select("key").distinct()
    joined = asked.join(head, "key", "left").join(body, "file_path", "left")
    error = F.when(F.col("_known").isNull(), F.concat(F.lit("Task '"), F.col("key"), F.lit("' not found"))).when(
        F.col("_body").isNull(),
        F.concat(F.lit("Index points to a missing document: "), F.col("file_path")),
    )
    return joined.withColumn("error", error).drop("_known", "_body")


def next_id(tasks: DataFrame) -> DataFrame:
    """Highest id plus one, 1 for an empty backlog."""
    return tasks.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("next_id"))


def check_unique_title(
    new: DataFrame, existing: DataFrame, seq: str = "seq", title: str = "title"
) -> DataFrame:
    """New rows with a ``reason`` when their title is taken by a task or by an earlier new row.

    Many rows may carry one title: the earliest is found by a minimum, not by sorting the group.
    """
    keyed = new.withColumn("_title", rules.title_key(title))
    taken = existing.select(rules.title_key(title).alias("_title")).distinct().withColumn("_taken", F.lit(True))
    first = keyed.groupBy("_title").agg(F.min(seq).alias("_first"))
    known = first.join(taken, "_title", "left")
    marked = salted_join(keyed, known, ["_title"], "left", spread=[seq])
    duplicate = F.col("_taken").isNotNull() | (F.col(seq) > F.col("_first"))
    reason = F.when(duplicate, F.concat(F.lit("Task with title '"), F.col(title), F.lit("' already exists.")))
    return marked.withColumn("reason", reason).select(*new.columns, "reason")


def assign_ids(new: DataFrame, tasks: DataFrame, seq: str = "seq", type_: str = "type") -> DataFrame:
    """Number new rows on from the highest id, in ``seq`` order; key is type and id.

    Numbering counts inside even shares of the batch and adds the shares before, so no task sees
    the whole batch.
    """
    start = next_id(tasks).scalar()
    ranked = split_rank(new, [], seq, name="_nth")
    numbered = ranked.withColumn("id", (start + F.col("_nth") - 1).cast("long"))
    return numbered.withColumn("key", F.concat(F.col(type_), F.col("id").cast("string"))).drop("_nth")


def add_tasks(
    new: DataFrame, tasks: DataFrame, project: str, now: Column | str, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with id and key, rejected rows with the reason). Ids go to accepted rows only.

    A row that fails its own rules does not claim its title.
    """
    trimmed = new
    if dict(new.dtypes).get("blocked_by") == "string":
        # One blocker may be given as a plain string.
        one = F.when(~is_blank(F.col("blocked_by")), F.array(strip(F.col("blocked_by"))))
        trimmed = new.withColumn("blocked_by", F.coalesce(one, F.array().cast("array<string>")))
    for c in ("title", "problem", "solution"):
        trimmed = trimmed.withColumn(c, strip(F.col(c)))
    filled = trimmed.withColumn("status", F.coalesce("status", F.lit("open"))).withColumn(
        "priority", F.coalesce("priority", F.lit("medium"))
    )
    judged = filled.withColumn("reason", rules.new_task_reason())
    sound = judged.where(F.col("reason").isNull()).drop("reason")
    checked = check_unique_title(sound, tasks, seq)
    rejected = judged.where(F.col("reason").isNotNull()).unionByName(
        checked.where(F.col("reason").isNotNull())
    )
    stamp = F.lit(now) if isinstance(now, str) else now
    accepted = assign_ids(checked.where(F.col("reason").isNull()).drop("reason"), tasks, seq)
    return accepted.withColumn("project", F.lit(project)).withColumn("updated", stamp), rejected


def unblock(tasks: DataFrame, completed: DataFrame, now: Column | None = None) -> DataFrame:
    """Open tasks whose blockers were completed: key, blocked_by (remaining), n_removed.

    A blocker may stand in the list of very many tasks; those rows are spread before the join.
    """
    waiting = tasks.where((F.col("status") == "open") & (F.size("blocked_by") > 0))
    links = waiting.select("key", F.posexplode("blocked_by").alias("_at", "_blocker"))
    done = completed.select(F.col("key").alias("_blocker")).distinct().withColumn("_done", F.lit(True))
    marked = salted_join(links, done, ["_blocker"], "left", spread=["key", "_at"])
    open_link = F.when(F.col("_done").isNull(), F.struct("_at", "_blocker"))
    per_task = marked.groupBy("key").agg(
        F.array_sort(F.collect_list(open_link)).alias("_left"),
        F.count_if(F.col("_done").isNotNull()).alias("n_removed"),
    )
    left = F.transform("_left", lambda x: x["_blocker"])
    return per_task.where("n_removed > 0").select("key", left.alias("blocked_by"), "n_removed")


def apply_unblock(tasks: DataFrame, completed: DataFrame, now: Column) -> DataFrame:
    """The backlog with completed blockers removed and changed tasks stamped."""
    freed = unblock(tasks, completed).select("key", F.col("blocked_by").alias("_left"))
    changed = F.col("_left").isNotNull()
    return (
        tasks.join(freed, "key", "left")
        .withColumn("blocked_by", F.when(changed, F.col("_left")).otherwise(F.col("blocked_by")))
        .withColumn("updated", F.when(changed, now).otherwise(F.col("updated")))
        .select(*tasks.columns)
    )


def complete_tasks(
    tasks: DataFrame, keys: DataFrame, resolution: str, now: Column, status: str = "closed"
) -> tuple[DataFrame, DataFrame]:
    """(new backlog, report per requested key). Any failing key leaves the backlog as it was.

    Validates every key first; the gate is one aggregated value in the same plan.
    """
    asked = keys.select("key").distinct()
    state = asked.join(tasks.select("key", F.col("status").alias("_old"), F.lit(True).alias("_known")), "key", "left")
    reason = F.coalesce(
        F.when(F.col("_known").isNull(), F.concat(F.lit("Task '"), F.col("key"), F.lit("' not found"))),
        rules.resolution_reason("_old", F.lit(status), F.lit(resolution)),
    )
    report = state.withColumn("reason", reason).select("key", "reason")
    all_good = F.coalesce(report.agg(F.bool_and(F.col("reason").isNull()).alias("ok")).scalar(), F.lit(False))
    hit = tasks.join(asked.withColumn("_hit", F.lit(True)), "key", "left")
    apply = F.col("_hit").isNotNull() & all_good
    closed = (
        hit.withColumn("status", F.when(apply, F.lit(status)).otherwise(F.col("status")))
        .withColumn("resolution", F.when(apply, F.lit(resolution)).otherwise(F.col("resolution")))
        .withColumn("updated", F.when(apply, now).otherwise(F.col("updated")))
        .select(*tasks.columns)
    )
    done = asked.where(all_good)
    return apply_unblock(closed, done, now), report


PROTECTED = ("id", "key", "project")


def update_tasks(
    tasks: DataFrame, patches: DataFrame, now: Column, transitions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new backlog, report per patch). Supplied fields win; id, key and project never change.

    A status change needs its resolution; pass a transitions table to check the move as well. Several
    patches of one key contradict each other and are all refused.
    """
    fields = [c for c in patches.columns if c not in PROTECTED and c in tasks.columns and c != "updated"]
    several = patches.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("_several"))
    given = patches.select("key", *[F.col(c).alias(f"_new_{c}") for c in fields]).join(several, "key", "left")
    known = tasks.select("key", F.col("status").alias("_old"), F.lit(True).alias("_known"))
    state = given.join(known, "key", "left")
    none = F.lit(None).cast("string")
    new_status = F.col("_new_status") if "status" in fields else none
    note = F.col("_new_resolution") if "resolution" in fields else none
    reasons = [
        F.when(F.col("_known").isNull(), F.concat(F.lit("Task '"), F.col("key"), F.lit("' not found"))),
        F.when(F.col("_several"), F.concat(F.lit("Several patches for task '"), F.col("key"), F.lit("'"))),
        rules.resolution_reason("_old", new_status, note),
    ]
    if transitions is not None:
        state = rules.check_transitions(
            state.withColumn("_to", new_status), transitions, "_old", "_to"
        ).withColumnRenamed("reason", "_move").drop("_to")
        reasons.append(F.col("_move"))
    judged = state.withColumn("reason", F.coalesce(*reasons))
    report = judged.select("key", "reason")
    accepted = judged.where(F.col("reason").isNull()).select("key", *[f"_new_{c}" for c in fields],
                                                             F.lit(True).alias("_hit"))
    joined = tasks.join(accepted, "key", "left")
    cols = [
        F.when(F.col("_hit"), now).otherwise(F.col("updated")).alias("updated") if c == "updated"
        else F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields
        else F.col(c)
        for c in tasks.columns
    ]
    return joined.select(*cols), report
