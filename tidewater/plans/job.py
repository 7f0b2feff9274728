"""The whole job: a task's parameters to its three result tables."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidewater.operators import SessionFilter, sample_sessions, session_aggr_stat, session_detail, session_random_extract, session_rollup, session_user_join
from tidewater.sources import actions_in_range, read_source, read_task, replace_task_jdbc, write_task_output, write_task_table
from tidewater.sources.scratch import discard, materialize

TABLES = ("session_aggr_stat", "session_random_extract", "session_detail")


class TaskReport(NamedTuple):
    """Rows that a task met on its way; counted by its writes, without jobs of their own."""

    sessions: int  # with a known user, before the filters
    kept: int  # that pass the filters
    sampled: int
    actions: int  # of the sampled sessions


@dataclass(frozen=True)
class TaskResult:
    """A task's results, as plans until they are written."""

    task_id: int
    actions: DataFrame
    joined: DataFrame  # sessions with their users
    condition: Column
    total: int
    seed: str

    @property
    def sessions(self) -> DataFrame:
        return self.joined.where(self.condition)

    @property
    def sampled(self) -> DataFrame:
        return sample_sessions(self.sessions, self.total, self.seed)

    @property
    def aggr_stat(self) -> DataFrame:
        return session_aggr_stat(self.sessions, self.task_id)

    @property
    def random_extract(self) -> DataFrame:
        return session_random_extract(self.sampled, self.task_id)

    @property
    def detail(self) -> DataFrame:
        return session_detail(self.actions, self.sampled, self.task_id)

    def write(self, path: str) -> TaskReport:
        """Write the three tables below ``path`` as parquet, in place of what an earlier run of the task left."""
        return self._run(lambda df, table: write_task_output(df, f"{path}/{table}", self.task_id))

    def write_tables(self, database: str) -> TaskReport:
        """Write the three tables of a database of the catalog, partitioned by task."""
        return self._run(lambda df, table: write_task_table(df, f"{database}.{table}", self.task_id))

    def write_jdbc(self, url: str, **options: str) -> TaskReport:
        """Write the three tables to a database; each table's old rows of the task are replaced in one transaction."""
        return self._run(lambda df, table: replace_task_jdbc(df, url, table, self.task_id, **options))

    def _run(self, sink: Callable[[DataFrame, str], int]) -> TaskReport:
        """The filtered sessions and the sample are written once to the shared folder, so neither a lost executor nor a further table computes them again."""
        seen = Observation()
        sessions = materialize(self.joined.observe(seen, F.count(F.lit(1)).alias("n")).where(self.condition), "task-sessions")
        sampled = None
        try:
            sampled = materialize(sample_sessions(sessions, self.total, self.seed), "task-sample")
            results = session_aggr_stat(sessions, self.task_id), session_random_extract(sampled, self.task_id), session_detail(self.actions, sampled, self.task_id)
            _, extracted, details = (sink(df, table) for df, table in zip(results, TABLES, strict=True))
            return TaskReport(seen.get.get("n") or 0, sessions.count(), extracted, details)  # the count of a stored table reads its footers
        finally:
            discard(sessions, *([sampled] if sampled is not None else []))


def run_task(actions: DataFrame | Callable[[str | None, str | None], DataFrame], users: DataFrame, tasks: DataFrame, task_id: int, total: int = 100, seed: str = "0") -> TaskResult:
    """Plan one task. A missing task raises; the task row is the only thing the driver reads.

    ``actions`` is the action log, or a function from the task's dates to that part of it, for logs whose ``date`` is not a stored column.
    """
    p = read_task(tasks, task_id)
    actions = actions(p.start_date, p.end_date) if callable(actions) else actions_in_range(actions, p.start_date, p.end_date)
    return TaskResult(task_id, actions, session_user_join(session_rollup(actions), users), SessionFilter.of(p).condition(), total, seed)


def main(argv: list[str] | None = None) -> TaskReport:
    """``spark-submit tidewater/plans/job.py TASK_ID --actions ... --users ... --tasks ... --out ...``

    Inputs are parquet paths, names of tables in the catalog (with ``--hive``: of the Hive metastore), or ``jdbc:`` addresses, whose tables are
    user_visit_action, user_info and task. ``--out`` is a folder, a database of the catalog or a ``jdbc:`` address. ``--option driver=...`` goes to every JDBC source and sink.
    """
    a = argparse.ArgumentParser(description="Run one task and write its three tables.")
    a.add_argument("task_id", type=int)
    for name in ("actions", "users", "tasks"):
        a.add_argument(f"--{name}", required=True, help="parquet path, table name or JDBC address")
    a.add_argument("--out", required=True, help="folder, database or JDBC address of the results")
    a.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="JDBC option, such as driver, user, password")
    a.add_argument("--hive", action="store_true", help="read tables of the Hive metastore")
    a.add_argument("--total", type=int, default=100)
    a.add_argument("--seed", default="0")
    x = a.parse_args(argv)
    builder = SparkSession.builder.enableHiveSupport() if x.hive else SparkSession.builder
    spark, options = builder.getOrCreate(), dict(o.split("=", 1) for o in x.option)
    actions, users, tasks = (read_source(spark, at, table, **options) for at, table in ((x.actions, "user_visit_action"), (x.users, "user_info"), (x.tasks, "task")))
    result = run_task(actions, users, tasks, x.task_id, x.total, x.seed)
    if x.out.startswith("jdbc:"):
        report = result.write_jdbc(x.out, **options)
    else:
        report = result.write(x.out) if "/" in x.out else result.write_tables(x.out)
    print(report)
    return report


if __name__ == "__main__":
    main()
