"""Task backlog checks per experiment.

Tasks: experiment_id, name, status, priority, dependencies array<string>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.operators import registry

DONE = ["passing", "skipped"]


def with_dependencies(tasks: DataFrame) -> DataFrame:
    """One row per task with the state of its dependencies summarised."""
    needs = tasks.select("experiment_id", "name", F.explode("dependencies").alias("dep"))
    states = tasks.select("experiment_id", F.col("name").alias("dep"), F.col("status").alias("dep_status"))
    joined = needs.join(states, ["experiment_id", "dep"], "left")
    found = F.col("dep_status").isNotNull()
    summary = joined.groupBy("experiment_id", "name").agg(
        F.bool_and(found & F.coalesce(F.col("dep_status").isin(DONE), F.lit(False))).alias("_all_done"),
        F.bool_or(F.coalesce(F.col("dep_status") == "failing", F.lit(False))).alias("_failing"),
        F.array_sort(F.collect_set(F.when(~found, F.col("dep")))).alias("missing_dependencies"),
    )
    return tasks.join(summary, ["experiment_id", "name"], "left").select(
        *tasks.columns,
        (~F.col("status").isin(DONE) & F.coalesce("_all_done", F.lit(True))).alias("is_runnable"),
        F.coalesce("_failing", F.lit(False)).alias("is_blocked"),
        F.coalesce("missing_dependencies", F.array().cast("array<string>")).alias("missing_dependencies"),
    )


def runnable(tasks: DataFrame) -> DataFrame:
    return with_dependencies(tasks).where("is_runnable")


def blocked(tasks: DataFrame) -> DataFrame:
    return with_dependencies(tasks).where("is_blocked")


def missing_dependencies(tasks: DataFrame) -> DataFrame:
    """(experiment, task, dependency) naming tasks that do not exist."""
    needs = tasks.select("experiment_id", "name", F.explode("dependencies").alias("dependency"))
    known = tasks.select("experiment_id", F.col("name").alias("dependency"))
    return needs.join(known, ["experiment_id", "dependency"], "left_anti")


def next_task(tasks: DataFrame) -> DataFrame:
    """Highest-priority runnable task per experiment, by name on ties."""
    return runnable(tasks).groupBy("experiment_id").agg(
        F.min(F.struct("priority", "name")).alias("t")
    ).select("experiment_id", "t.name", "t.priority")


def progress(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("experiment_id", "status").agg(F.count("*").alias("n"))


def bootup(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Pending, failing and passing lists, last analysis run and the recommendation."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("ord", "name"))))
    lists = tasks.groupBy("experiment_id").agg(
        *[F.transform(names(s), lambda x: x["name"]).alias(s) for s in ("pending", "failing", "passing")]
    )
    last = registry.latest_event(
        events.where(F.col("type") == "analysis"), ["experiment_id"], ["ts", "event_id"], ["analysis", "ts"]
    ).withColumnsRenamed({"analysis": "last_analysis", "ts": "last_run"})
    advice = (
        F.when(F.size("failing") > 0, F.concat(F.lit("Fix failing tasks first: "), F.array_join("failing", ", ")))
        .when(F.size("pending") > 0, F.concat(F.lit("Next task: "), F.col("pending")[0]))
        .otherwise("All tasks complete!")
    )
    return lists.join(last, "experiment_id", "left").withColumn("recommendation", advice)
