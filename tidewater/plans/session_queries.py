"""Registered session queries over the test tables, with the same query in SQL.

The tables have no session id: a session is one user's day in ``events`` (see
``tidewater.sources.actions``). Only ``action_date_range`` and the tasks have a date range; all other queries read every action.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import (
    SessionFilter, sample_quota, sample_sessions, session_aggr_stat, session_count, session_detail, session_random_extract,
    session_rollup, session_user_join, sessions_per_day, sessions_per_hour, step_length_histogram, visit_length_histogram,
    STEP_BUCKETS, VISIT_BUCKETS,
)
from tidewater.plans.job import TaskResult, run_task
from tidewater.sources import actions_in_range, adapt_actions, adapt_users, save_actions, task_params, user_dim, write_task_output
from tidewater.sources.scratch import scratch_path

START, END, TOTAL, TASK_ID, SEED = "2024-01-03", "2024-01-20", 1000, 2, "0"
MANY = 100_000  # a sample far beyond what Spark's window group limit cuts
PROFESSIONALS, CITIES, KEYWORDS, CATEGORIES = ("BUILDING", "FURNITURE", "MACHINERY"), ("NATION_1", "NATION_2"), ("kw1", "kw2"), (5, 7)
ALL_CITIES, ALL_KEYWORDS, ALL_CATEGORIES = tuple(f"NATION_{i}" for i in range(15)), tuple(f"kw{i}" for i in range(8)), tuple(range(80))
#: Parameters of the task of region k: each task has others. Those of the second are START, END, ages 20 to 60, PROFESSIONALS, KEYWORDS.
TASK_PARAM = '{"startDate":["2024-01-0<2+k>"],"endDate":["2024-01-<21-k>"],"startAge":["<19+k>"],"endAge":["<61-k>"],"professionals":["BUILDING,FURNITURE,MACHINERY"],"keywords":["kw<k>,kw<1+k>"]}'


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return adapt_actions(spark, d)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return session_user_join(session_rollup(_actions(spark, d)), adapt_users(spark, d))


def _flat(df: DataFrame) -> DataFrame:
    """Lists and times as text, so that results compare in any engine."""
    out = {}
    for c, kind in df.dtypes:
        if kind.startswith("array"):
            out[c] = F.array_join(c, ",")
        elif kind.startswith("timestamp"):
            out[c] = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


def _filtered(**kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _flat(SessionFilter(**kw).apply(_sessions(spark, d)))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """The task table: a record per region, each with parameters of its own."""
    r = spark.read.parquet(f"{d}/region.parquet").withColumn("k", F.col("r_regionkey"))
    param = F.concat(*(F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(re.split("[<>]", TASK_PARAM))))
    return r.select((F.col("k") + 1).cast("int").alias("task_id"), F.col("r_name").alias("task_name"), param.alias("task_param"))


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return sample_sessions(_sessions(spark, d), TOTAL, SEED)


def _task(spark: SparkSession, d: str) -> TaskResult:
    return run_task(lambda start, end: adapt_actions(spark, d, start, end), adapt_users(spark, d), _tasks(spark, d), TASK_ID, TOTAL, SEED)


def _job(spark: SparkSession, d: str, which: str) -> DataFrame:
    return getattr(_task(spark, d), which)


def _sink(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write twice and read back: a re-run must leave no duplicates."""
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    write_task_output(df, path, TASK_ID)
    write_task_output(df, path, TASK_ID)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _rerun_without_rows(spark: SparkSession, d: str) -> DataFrame:
    """The samples of two tasks are written; the second task runs again and nothing survives: what is left is the first task's."""
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex}")
    rows = session_random_extract(_sampled(spark, d), TASK_ID)
    write_task_output(rows, path, TASK_ID)
    write_task_output(rows, path, TASK_ID + 1)
    write_task_output(rows.where(F.lit(False)), path, TASK_ID + 1)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """The actions as a table of the catalog, partitioned by date and bucketed by session."""
    table = f"tidewater_actions_{uuid.uuid4().hex}"
    return save_actions(_actions(spark, d), table, int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, table))


def _saved_detail(spark: SparkSession, d: str) -> DataFrame:
    actions = _saved(spark, d)
    sampled = sample_sessions(session_user_join(session_rollup(actions), adapt_users(spark, d)), TOTAL, SEED)
    return session_detail(actions, sampled, TASK_ID)


def _report(spark: SparkSession, d: str) -> DataFrame:
    """A whole task, written: what its report says, beside the sums over the tables that it wrote."""
    path = scratch_path(spark, f"task-{uuid.uuid4().hex}")
    report = _task(spark, d).write(path)
    stat = spark.read.parquet(f"{path}/session_aggr_stat").select(F.col("session_count").cast("bigint").alias("kept"))
    count = lambda table, name: spark.read.parquet(f"{path}/{table}").agg(F.count(F.lit(1)).alias(name))
    counted = F.lit(report.sessions).cast("bigint").alias("sessions")
    rows = stat.join(count("session_random_extract", "sampled"), how="cross").join(count("session_detail", "actions"), how="cross")  # one row each
    return rows.select(counted, "kept", "sampled", "actions")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "action_date_range": lambda s, d: adapt_actions(s, d, START, END),
        "user_dim": lambda s, d: user_dim(adapt_users(s, d)),
        "task_params": lambda s, d: task_params(_tasks(s, d), TASK_ID),
        "session_rollup": lambda s, d: _flat(session_rollup(_actions(s, d))),
        "session_user_join": lambda s, d: _flat(_sessions(s, d)),
        "session_count": lambda s, d: session_count(_sessions(s, d)),
        "filter_age": _filtered(start_age=20, end_age=60),
        "filter_professional": _filtered(professionals=PROFESSIONALS),
        "filter_city": _filtered(cities=CITIES),
        "filter_sex": _filtered(sex="male"),
        "filter_keywords": _filtered(keywords=KEYWORDS),
        "filter_categories": _filtered(category_ids=CATEGORIES),
        "filter_all": _filtered(start_age=20, end_age=60, professionals=PROFESSIONALS, cities=ALL_CITIES, sex="male", keywords=ALL_KEYWORDS, category_ids=ALL_CATEGORIES),
        "sessions_per_hour": lambda s, d: sessions_per_hour(_sessions(s, d)),
        "sessions_per_day": lambda s, d: sessions_per_day(_sessions(s, d)),
        "visit_length_histogram": lambda s, d: visit_length_histogram(_sessions(s, d)),
        "step_length_histogram": lambda s, d: step_length_histogram(_sessions(s, d)),
        "session_aggr_stat": lambda s, d: session_aggr_stat(_sessions(s, d), TASK_ID),
        "sample_quota": lambda s, d: sample_quota(_sessions(s, d), TOTAL),
        "session_random_extract": lambda s, d: session_random_extract(_sampled(s, d), TASK_ID),
        "session_detail": lambda s, d: session_detail(_actions(s, d), _sampled(s, d), TASK_ID),
        "sink_aggr_stat": lambda s, d: _sink(s, session_aggr_stat(_sessions(s, d), TASK_ID)),
        "sink_random_extract": lambda s, d: _sink(s, session_random_extract(_sampled(s, d), TASK_ID)),
        "sink_detail": lambda s, d: _sink(s, session_detail(_actions(s, d), _sampled(s, d), TASK_ID)),
        "run_task_aggr_stat": lambda s, d: _job(s, d, "aggr_stat"),
        "run_task_detail": lambda s, d: _job(s, d, "detail"),
        "run_task_report": _report,
        "sink_rerun_without_rows": _rerun_without_rows,
        "saved_date_range": lambda s, d: actions_in_range(_saved(s, d), START, END).select(*_actions(s, d).columns),
        "saved_session_rollup": lambda s, d: _flat(session_rollup(_saved(s, d))),
        "saved_session_detail": _saved_detail,
        "large_random_extract": lambda s, d: session_random_extract(sample_sessions(_sessions(s, d), MANY, SEED), TASK_ID),
    }


_ACTIONS = """
actions AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id, CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
    k % 10 AS page_id, CAST(date_trunc('second', ts) AS VARCHAR) AS action_time,
    CASE WHEN event_type = 'view' THEN 'kw' || CAST(k % 10 AS VARCHAR) END AS search_keyword,
    CASE WHEN event_type = 'click' THEN k END AS click_category_id, CASE WHEN event_type = 'click' THEN event_id % 100 END AS click_product_id,
    CASE WHEN event_type = 'signup' THEN CAST(k AS VARCHAR) END AS order_category_ids, CASE WHEN event_type = 'signup' THEN CAST(event_id % 100 AS VARCHAR) END AS order_product_ids,
    CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_category_ids, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 100 AS VARCHAR) END AS pay_product_ids
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
_RANGE = _ACTIONS.replace("FROM events)", f"FROM events WHERE CAST(ts AS DATE) BETWEEN '{START}' AND '{END}')")
_USERS = """,
users AS (
  SELECT c_custkey AS user_id, c_name AS username, c_name AS name, CAST(18 + c_custkey % 60 AS INTEGER) AS age, c_mktsegment AS professional,
    n_name AS city, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_ROLLUP = """,
rollup AS (
  SELECT session_id, arg_min(user_id, (CAST(action_time AS TIMESTAMP), user_id)) AS user_id,
    coalesce(list_sort(list(DISTINCT search_keyword) FILTER (WHERE search_keyword <> '')), []) AS kws,
    coalesce(list_sort(list(DISTINCT click_category_id) FILTER (WHERE click_category_id IS NOT NULL)), []) AS cats,
    min(CAST(action_time AS TIMESTAMP)) AS start_at, max(CAST(action_time AS TIMESTAMP)) AS end_at, count(*) AS step_length
  FROM actions GROUP BY session_id),
flat AS (
  SELECT session_id, user_id, array_to_string(kws, ',') AS search_keywords, array_to_string(cats, ',') AS click_category_ids,
    strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_time, step_length,
    CAST(epoch(end_at) - epoch(start_at) AS BIGINT) AS visit_length, kws, cats
  FROM rollup),
sessions AS (SELECT f.*, age, professional, city, sex FROM flat f JOIN users u USING (user_id))"""
_OUT = "SELECT user_id, session_id, search_keywords, click_category_ids, start_time, end_time, step_length, visit_length, age, professional, city, sex FROM sessions"
_HOURS = """,
hours AS (SELECT substr(start_time, 1, 10) AS date, CAST(substr(start_time, 12, 2) AS INTEGER) AS hour, count(*) AS n FROM kept GROUP BY ALL)"""
_QUOTA = _HOURS + f""",
quota AS (
  SELECT date, hour, n, least(n, CAST(floor(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY date) AS DOUBLE) * ({TOTAL} // (SELECT count(DISTINCT date) FROM hours))) AS BIGINT)) AS quota
  FROM hours),
sampled AS (
  SELECT * FROM (SELECT k.*, quota, row_number() OVER (PARTITION BY q.date, q.hour ORDER BY md5('{SEED}:' || session_id), session_id) AS rn
    FROM kept k JOIN quota q ON substr(start_time, 1, 10) = q.date AND CAST(substr(start_time, 12, 2) AS INTEGER) = q.hour) WHERE rn <= quota)"""
_KEPT = ",\nkept AS (SELECT * FROM sessions)"


def _histogram(column: str, buckets: tuple) -> list[str]:
    return [f"count(*) FILTER (WHERE {column} >= {lo}{'' if hi is None else f' AND {column} <= {hi}'}) AS {column}_{name}" for name, lo, hi in buckets]


def _stat(kept: str) -> str:
    parts = [(f"{c}_{b[0]}", h.split(" AS ")[0]) for c, bs in (("visit_length", VISIT_BUCKETS), ("step_length", STEP_BUCKETS)) for b, h in zip(bs, _histogram(c, bs), strict=True)]
    ratios = ", ".join(f"CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST((200 * {h} + count(*)) // (2 * count(*)) AS DOUBLE) / 100 END AS {n}" for n, h in parts)
    return f"SELECT CAST({TASK_ID} AS INTEGER) AS task_id, CAST(count(*) AS INTEGER) AS session_count, {ratios} FROM {kept}"


def oracle_sql() -> dict[str, str]:
    base = f"WITH {_ACTIONS}{_USERS}{_ROLLUP}{_KEPT}"
    where = {
        "filter_age": "age BETWEEN 20 AND 60",
        "filter_professional": f"professional IN {PROFESSIONALS}",
        "filter_city": f"city IN {CITIES}",
        "filter_sex": "sex = 'male'",
        "filter_keywords": f"list_has_any(kws, {list(KEYWORDS)})",
        "filter_categories": f"list_has_any(cats, {list(CATEGORIES)})",
    }
    extract = f"SELECT CAST({TASK_ID} AS INTEGER) AS task_id, session_id, start_time, nullif(click_category_ids, '') AS click_category_ids, nullif(search_keywords, '') AS search_keywords FROM sampled"
    detail = f"SELECT CAST({TASK_ID} AS INTEGER) AS task_id, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids FROM actions WHERE session_id IN (SELECT session_id FROM sampled)"
    job = f"WITH {_RANGE}{_USERS}{_ROLLUP},\nkept AS (SELECT * FROM sessions WHERE {where['filter_age']} AND {where['filter_professional']} AND {where['filter_keywords']})"
    param = " || ".join(f"CAST({p} AS VARCHAR)" if i % 2 else f"'{p}'" for i, p in enumerate(re.split("[<>]", TASK_PARAM)))
    tasks = f"(SELECT CAST(k + 1 AS INTEGER) AS task_id, {param} AS p FROM (SELECT r_regionkey AS k FROM region))"
    first = lambda k: f"nullif(json_extract_string(p, '$.{k}[0]'), '') AS {k}"
    stat = f"{base} {_stat('kept')}"
    return {
        "action_date_range": f"WITH {_RANGE} SELECT * FROM actions",
        "user_dim": f"WITH {_USERS.lstrip(', ')} SELECT * FROM users",
        "task_params": f"SELECT task_id, {', '.join(map(first, ('startDate', 'endDate', 'startAge', 'endAge', 'professionals', 'cities', 'sex', 'keywords', 'categoryIds')))} FROM {tasks} WHERE task_id = {TASK_ID}",
        "session_rollup": f"{base} SELECT * EXCLUDE (kws, cats) FROM flat",
        "session_user_join": f"{base} {_OUT}",
        "session_count": f"{base} SELECT count(*) AS session_count FROM sessions",
        **{k: f"{base} {_OUT} WHERE {w}" for k, w in where.items()},
        "filter_all": f"{base} {_OUT} WHERE {where['filter_age']} AND {where['filter_professional']} AND {where['filter_sex']} AND city IN {ALL_CITIES} AND list_has_any(kws, {list(ALL_KEYWORDS)}) AND list_has_any(cats, {list(ALL_CATEGORIES)})",
        "sessions_per_hour": f"{base}{_HOURS} SELECT * FROM hours",
        "sessions_per_day": f"{base}{_HOURS} SELECT date, CAST(sum(n) AS BIGINT) AS n FROM hours GROUP BY date",
        "visit_length_histogram": f"{base} SELECT {', '.join(_histogram('visit_length', VISIT_BUCKETS))} FROM sessions",
        "step_length_histogram": f"{base} SELECT {', '.join(_histogram('step_length', STEP_BUCKETS))} FROM sessions",
        "session_aggr_stat": stat,
        "sample_quota": f"{base}{_QUOTA} SELECT date, hour, n, quota FROM quota",
        "session_random_extract": f"{base}{_QUOTA} {extract}",
        "session_detail": f"{base}{_QUOTA} {detail}",
        "sink_aggr_stat": stat,
        "sink_random_extract": f"{base}{_QUOTA} {extract}",
        "sink_detail": f"{base}{_QUOTA} {detail}",
        "run_task_aggr_stat": f"{job} {_stat('kept')}",
        "run_task_detail": f"{job}{_QUOTA} {detail}",
        "run_task_report": f"{job}{_QUOTA} SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM sampled) AS sampled, (SELECT count(*) FROM ({detail})) AS actions",
        "sink_rerun_without_rows": f"{base}{_QUOTA} {extract}",
        "saved_date_range": f"WITH {_RANGE} SELECT * FROM actions",
        "saved_session_rollup": f"{base} SELECT * EXCLUDE (kws, cats) FROM flat",
        "saved_session_detail": f"{base}{_QUOTA} {detail}",
        "large_random_extract": f"{base}{_QUOTA.replace(f'{TOTAL} //', f'{MANY} //')} {extract}",
    }
