"""Boundary rows of the session operators."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import half_up_ratio, is_empty, parse_time, trim_comma
from tidewater.operators import (
    SessionFilter, sample_quota, sample_sessions, session_aggr_stat, session_detail, session_random_extract, session_rollup, session_user_join,
    sessions_per_hour, step_length_histogram, visit_length_histogram,
)
from tidewater.operators import sampling
from tidewater.plans import run_task
from tidewater.plans.job import main
from tidewater.sources import actions_in_range, adapt_actions, read_task, read_task_jdbc, replace_task_jdbc, save_actions, task_params, write_jdbc, write_task_output, write_task_table

ACTION = "date string, user_id long, session_id string, page_id long, action_time string, search_keyword string, click_category_id long, click_product_id long, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string"
USER = "user_id long, username string, name string, age int, professional string, city string, sex string"
TASK = "task_id int, task_name string, create_time string, start_time string, finish_time string, task_type string, task_status string, task_param string"


def actions(spark, rows):
    """rows: (session, time[, keyword[, category[, user]]])"""
    full = []
    for r in rows:
        s, t, kw, cat, user = (*r, *(None,) * (5 - len(r)))
        full.append((t[:10] if t else None, 1 if user is None else user, s, 0, t, kw, cat, cat, None, None, None, None))
    return spark.createDataFrame(full, ACTION)


def at(seconds, day="2024-01-01"):
    return f"{day} {seconds // 3600}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def users(spark, *rows):
    return spark.createDataFrame(list(rows) or [(1, "u", "n", 30, "p", "c", "male")], USER)


def test_visit_edges(spark):
    lengths = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    rows = [(f"s{n}", at(t)) for n in lengths for t in (0, n)]
    got = visit_length_histogram(session_rollup(actions(spark, rows))).first()
    assert list(got) == [2] * 8 + [1]


def test_step_edges(spark):
    rows = [(f"s{n}", at(i)) for n in [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61] for i in range(n)]
    assert list(step_length_histogram(session_rollup(actions(spark, rows))).first()) == [2, 2, 2, 2, 2, 1]


def test_ratio_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 200), (0, 0), (1, None)], "c long, n long")
    assert [r[0] for r in df.select(half_up_ratio(F.col("c"), F.col("n"))).collect()] == [0.13, 0.01, 0.0, 0.0]


def test_times_and_distinct_values(spark):
    rows = [("s", "2024-01-01 7:05:09", "", 10), ("s", "2024-01-01 07:05:10", "b", 1), ("s", None, "a", 10), ("s", "nonsense", "b", None), ("s", "2024-01-01 07:05:10", None, None)]
    r = session_rollup(actions(spark, rows)).first()
    assert (r.visit_length, str(r.start_time), r.step_length) == (1, "2024-01-01 07:05:09", 5)
    assert (r.search_keywords, r.click_category_ids) == (["a", "b"], [1, 10])


def test_session_without_readable_time(spark):
    r = session_rollup(actions(spark, [("s", None)])).first()
    assert (r.visit_length, r.start_time, r.step_length) == (0, None, 1)


def test_user_of_session_is_the_earliest_then_smallest(spark):
    rows = [("s", at(5), None, None, 1), ("s", at(3), None, None, 9), ("s", at(3), None, None, 7)]
    assert session_rollup(actions(spark, rows)).first().user_id == 7


def test_filters(spark):
    s = session_user_join(session_rollup(actions(spark, [("a", at(1), "k1", 5), ("b", at(1), None, None, 2), ("x", at(1), "k1", 5, 99)])), users(spark, (1, "u", "n", 30, "p", "c", "male"), (2, "u", "n", 20, None, None, None)))
    ids = lambda **kw: sorted(r.session_id for r in SessionFilter(**kw).apply(s).collect())
    assert ids() == ["a", "b"]  # the unknown user's session is absent
    assert ids(start_age=25) == ["a", "b"]  # one bound alone is ignored
    assert ids(start_age=20, end_age=20) == ["b"]
    assert ids(cities=("null",)) == []
    assert ids(keywords=("k1", "zz")) == ["a"]
    assert ids(category_ids=(5,)) == ["a"]
    assert ids(sex="male") == ["a"]
    assert ids(professionals=("p", "q")) == ["a"]


def test_no_survivors(spark):
    s = SessionFilter(sex="none").apply(session_user_join(session_rollup(actions(spark, [("a", at(1))])), users(spark)))
    r = session_aggr_stat(s, 7).first()
    assert (r.task_id, r.session_count) == (7, 0) and set(list(r)[2:]) == {0.0}
    assert sample_quota(s).count() == 0 and sample_sessions(s).count() == 0


def test_quota_in_doubles(spark):
    rows = [(f"a{i}", at(3600)) for i in range(29)] + [(f"b{i}", at(7200)) for i in range(71)]
    s = session_user_join(session_rollup(actions(spark, rows)), users(spark))
    assert sorted((r.hour, r.quota) for r in sample_quota(s, 100).collect()) == [(1, 28), (2, 71)]
    got = sample_sessions(s, 100)
    assert sorted((r.hour, r.n) for r in sessions_per_hour(got).collect()) == [(1, 28), (2, 71)]
    assert {r.session_id for r in got.collect()} == {r.session_id for r in sample_sessions(s.repartition(7), 100).collect()}
    assert {r.session_id for r in got.collect()} != {r.session_id for r in sample_sessions(s, 100, seed="9").collect()}


def test_more_days_than_total(spark):
    rows = [(f"s{d}", at(0, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}")) for d in range(101)]
    s = session_user_join(session_rollup(actions(spark, rows)), users(spark))
    assert sample_sessions(s, 100).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("total", [30, 3000])
def test_a_busy_hour_is_cut_before_the_shuffle(spark, total):
    rows = [(f"s{i}", at(3600)) for i in range(6000)]
    s = session_user_join(session_rollup(actions(spark, rows)), users(spark))
    got = sample_sessions(s, total)
    every = sorted((r.h, r.session_id) for r in s.select("session_id", F.md5(F.concat(F.lit("0:"), F.col("session_id"))).alias("h")).collect())
    assert {r.session_id for r in got.collect()} == {x for _, x in every[:total]}
    assert "BroadcastHashJoin" in plan_of(got)
    near = sampling.candidates(s, total, "0").count()  # what is shuffled to be ranked
    assert total <= near <= 1.3 * total + 20


def test_ties_of_the_hash_class_are_all_candidates(spark):
    rows = [(f"s{i}", at(60 * (i % 3))) for i in range(50)]
    s = session_user_join(session_rollup(actions(spark, rows)), users(spark))
    every = sorted((r.h, r.session_id) for r in s.select("session_id", F.md5(F.concat(F.lit("x:"), F.col("session_id"))).alias("h")).collect())
    for total in range(1, 51, 7):
        assert {r.session_id for r in sample_sessions(s, total, "x").collect()} == {x for _, x in every[:total]}


def test_rollup_has_no_object_or_sort_aggregate_over_actions(spark):
    plan = plan_of(session_rollup(actions(spark, [("s", at(1), "k", 5)])))
    below = plan[plan.index("partial_min(at"):]  # the first level
    assert "ObjectHashAggregate" not in below and "SortAggregate" not in below
    assert "SortAggregate" not in plan


def test_a_hot_session_is_reduced_before_its_merge(spark):
    rows = [("hot", at(i), f"k{i % 3}", i % 4) for i in range(3000)] + [("s", at(1), "k", 5)]
    g = {r.session_id: r for r in session_rollup(actions(spark, rows)).collect()}
    assert (g["hot"].step_length, g["hot"].visit_length, g["hot"].search_keywords, g["hot"].click_category_ids) == (3000, 2999, ["k0", "k1", "k2"], [0, 1, 2, 3])


def test_saved_actions_are_read_without_a_shuffle(spark, tmp_path):
    rows = [(f"s{i % 30}", at(i, f"2024-01-0{1 + i % 3}"), f"k{i % 4}", i % 5) for i in range(300)]
    plain = actions(spark, rows)
    saved = save_actions(plain, "saved_actions", 4, f"file://{tmp_path}/saved")
    try:
        rollup = session_rollup(saved)
        assert "Exchange" not in plan_of(rollup)
        assert sorted(map(str, rollup.collect())) == sorted(map(str, session_rollup(plain).collect()))
        spark.createDataFrame([("s3",), ("s4",)], "session_id string").write.parquet(f"file://{tmp_path}/sample")
        sampled = spark.read.parquet(f"file://{tmp_path}/sample")  # of a size that Spark knows
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        for limit in (before, "-1"):  # a small and a large sample
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            detail = session_detail(saved, sampled, 1)
            assert detail.count() == 20
            assert plan_of(detail).count("Exchange hashpartitioning") == (limit == "-1")  # of the sample only
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        ranged = actions_in_range(spark.table("saved_actions"), "2024-01-02", "2024-01-02")
        assert "PartitionFilters: [isnotnull(date" in plan_of(ranged) and "2024-01-02" in plan_of(ranged)
        assert ranged.count() == 100
    finally:
        spark.sql("DROP TABLE saved_actions")


def test_partitions_do_not_matter(spark):
    a = actions(spark, [(f"s{i % 40}", at(i * 7 % 4000), f"k{i % 3}", i % 5) for i in range(400)])
    stat = lambda df: session_aggr_stat(session_rollup(df), 1).first()
    assert stat(a.coalesce(1)) == stat(a.repartition(8))


def test_sample_and_detail(spark):
    a = actions(spark, [(f"s{i % 50}", at(i), "kw" if i % 2 else None, None) for i in range(200)])
    sampled = sample_sessions(session_user_join(session_rollup(a), users(spark)), 10)
    detail = session_detail(a, sampled, 3)
    assert detail.count() == sum(r.step_length for r in sampled.collect()) == 40
    assert len(detail.columns) == 12
    extract = session_random_extract(sampled, 3)
    assert {r.click_category_ids for r in extract.collect()} == {None}


def test_date_range(spark):
    a = actions(spark, [("s", f"2024-01-0{d} 1:00:00") for d in range(1, 6)])
    assert actions_in_range(a, "2024-01-02", "2024-01-04").count() == 3
    assert actions_in_range(a, None, "2024-01-02").count() == 2
    assert actions_in_range(a).count() == 5


def task(spark, param, task_id=1):
    return spark.createDataFrame([(task_id, "t", "", "", "", "", "", param)], TASK)


def test_task_parameters(spark):
    p = read_task(task(spark, '{"startAge":["20"],"endAge":["60"],"cities":["a,b","c"],"sex":[""],"keywords":[]}'), 1)
    assert (p.start_age, p.end_age, p.cities, p.sex, p.keywords, p.start_date) == (20, 60, ("a", "b"), None, None, None)
    with pytest.raises(LookupError):
        read_task(task(spark, "{}"), 2)
    assert task_params(task(spark, "{}"), 1).first().cities is None


def test_run_task_and_write_twice(spark, tmp_path):
    a = actions(spark, [(f"s{i % 30}", at(i), "k1", 5) for i in range(90)] + [("x", at(1), "k1", 5, 99)])
    out = run_task(a, users(spark), task(spark, '{"sex":["male"]}'), 1, total=10)
    for _ in range(2):
        assert out.write(f"file://{tmp_path}") == (30, 30, 10, 30)
    read = lambda n: spark.read.parquet(f"file://{tmp_path}/{n}")
    assert read("session_aggr_stat").count() == 1
    assert read("session_random_extract").count() == 10
    assert read("session_detail").count() == 30
    other = run_task(a, users(spark), task(spark, "{}", 2), 2, total=10)
    write_task_output(other.detail, f"file://{tmp_path}/session_detail", 2)
    assert read("session_detail").groupBy("task_id").count().count() == 2


def test_a_rerun_without_survivors_leaves_no_rows(spark, tmp_path):
    a = actions(spark, [(f"s{i % 30}", at(i), "k1", 5) for i in range(90)])
    for t, sex in ((1, "male"), (2, "male"), (1, "none")):
        report = run_task(a, users(spark), task(spark, f'{{"sex":["{sex}"]}}', t), t, total=10).write(f"file://{tmp_path}")
    assert report == (30, 0, 0, 0)
    read = lambda n: spark.read.parquet(f"file://{tmp_path}/{n}")
    for table in ("session_random_extract", "session_detail"):
        assert {r.task_id for r in read(table).collect()} == {2}
    assert {(r.task_id, r.session_count) for r in read("session_aggr_stat").collect()} == {(1, 0), (2, 30)}


def test_a_first_run_without_survivors_can_be_read(spark, tmp_path):
    out = run_task(actions(spark, [("s", at(1))]), users(spark), task(spark, '{"sex":["none"]}'), 1)
    assert out.write(f"file://{tmp_path}") == (1, 0, 0, 0)
    assert spark.read.parquet(f"file://{tmp_path}/session_detail").count() == 0


def test_rows_of_a_table_of_the_catalog_are_replaced(spark, tmp_path):
    spark.sql(f"CREATE TABLE extract_rows (session_id string, task_id int) USING parquet PARTITIONED BY (task_id) LOCATION 'file://{tmp_path}/t'")
    try:
        df = spark.createDataFrame([(1, "a"), (1, "b")], "task_id int, session_id string")
        for t, rows in ((1, df), (2, df), (1, df), (2, df.limit(0))):
            assert write_task_table(rows, "extract_rows", t) == rows.count()
        assert sorted((r.task_id, r.session_id) for r in spark.table("extract_rows").collect()) == [(1, "a"), (1, "b")]
    finally:
        spark.sql("DROP TABLE extract_rows")


def test_sessions_and_sample_are_computed_once(spark, tmp_path):
    """The rollup reads the actions once, the detail once more."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    a = actions(spark, [(f"s{i % 30}", at(i), "k1", 5) for i in range(90)]).mapInArrow(seen, ACTION)
    run_task(a, users(spark), task(spark, "{}"), 1, total=10).write(f"file://{tmp_path}")
    assert calls.value == 180


@pytest.mark.parametrize("how", ["paths", "tables", "jdbc"])
def test_main(spark, tmp_path, how):
    log, people, record = actions(spark, [(f"s{i % 30}", at(i), "k1", 5) for i in range(90)]), users(spark), task(spark, '{"sex":["male"]}', 5)
    options = ["--total", "10"]
    if how == "paths":
        at_, out = {n: f"file://{tmp_path}/{n}" for n in "aut"}, f"file://{tmp_path}/out"
        for n, df in zip("aut", (log, people, record), strict=True):
            df.write.parquet(at_[n])
    elif how == "tables":
        at_, out = {n: f"main_{n}" for n in "aut"}, "results"
        spark.sql(f"CREATE DATABASE results LOCATION 'file://{tmp_path}/results'")
        save_actions(log, at_["a"], 2, f"file://{tmp_path}/a")
        people.write.option("path", f"file://{tmp_path}/u").saveAsTable(at_["u"])
        record.write.option("path", f"file://{tmp_path}/t").saveAsTable(at_["t"])
    else:
        at_, out = dict.fromkeys("aut", "jdbc:derby:memory:main;create=true"), "jdbc:derby:memory:main;create=true"
        options += ["--option", "driver=org.apache.derby.iapi.jdbc.AutoloadedDriver"]
        for n, df in zip(("user_visit_action", "user_info", "task"), (log, people, record), strict=True):
            write_jdbc(df, out, n, mode="overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    args = ["--actions", at_["a"], "--users", at_["u"], "--tasks", at_["t"], "--out", out, *options]
    try:
        for _ in range(2):
            assert main(["5", *args]) == (30, 30, 10, 30)
        read = (lambda n: read_task_jdbc(spark, out, n, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")) if how == "jdbc" else lambda n: spark.table(f"{out}.{n}") if how == "tables" else spark.read.parquet(f"{out}/{n}")
        assert read("session_aggr_stat").first().session_count == 30
        assert (read("session_random_extract").count(), read("session_detail").count()) == (10, 30)
        with pytest.raises(LookupError):
            main(["6", *args])
    finally:
        if how == "tables":
            spark.sql("DROP DATABASE results CASCADE")
            for n in "aut":
                spark.sql(f"DROP TABLE IF EXISTS main_{n}")


def test_dates_of_a_task_reach_the_scan(spark):
    plan = adapt_actions(spark, "/root/testdata/sf0.001", "2024-01-03", "2024-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_jdbc_results_are_replaced(spark):
    url, driver = "jdbc:derby:memory:results;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "a"), (1, "b")], "task_id int, session_id string")
    write_jdbc(df, url, "session_detail", mode="overwrite", **driver)
    write_jdbc(df.selectExpr("2 AS task_id", "session_id"), url, "session_detail", **driver)
    for _ in range(2):
        replace_task_jdbc(df, url, "session_detail", 1, **driver)
    assert read_task_jdbc(spark, url, "session_detail", **driver).groupBy("task_id").count().orderBy("task_id").collect() == [(1, 2), (2, 2)]


def test_a_failed_jdbc_write_leaves_the_old_rows(spark):
    url, driver = "jdbc:derby:memory:failing;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = lambda: sorted((r.task_id, r.session_id) for r in read_task_jdbc(spark, url, "extract", **driver).collect())
    df = spark.createDataFrame([(1, "a"), (1, "b")], "task_id int, session_id string")
    assert replace_task_jdbc(df, url, "extract", 1, **driver) == 2
    more = spark.range(0, 400, 1, 4).select(F.lit(1).alias("task_id"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.lit("z")).cast("string").alias("session_id"))
    with pytest.raises(Exception, match="lost"):
        replace_task_jdbc(more, url, "extract", 1, **driver)  # one task fails, the others' rows are in the staging table
    assert rows() == [(1, "a"), (1, "b")]
    assert replace_task_jdbc(df.limit(0), url, "extract", 1, **driver) == 0
    assert rows() == []
    tables = spark.read.format("jdbc").options(url=url, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", **driver).load()
    assert [r[0].lower() for r in tables.collect()] == ["extract"]  # no staging table is left


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:tasks;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    write_jdbc(task(spark, '{"sex":["male"]}').union(task(spark, "{}", 2)), url, "task", mode="overwrite", **driver)
    df = read_task_jdbc(spark, url, **driver)
    assert read_task(df, 1).sex == "male"
    plan = df.where("task_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(TASK_ID), *EqualTo(TASK_ID,1)]" in plan or "EqualTo" in plan


def test_scalars(spark):
    df = spark.createDataFrame([(",a,b,",), ("",), (None,)], "s string")
    assert [tuple(r) for r in df.select(trim_comma(F.col("s")), is_empty(F.col("s"))).collect()] == [("a,b", False), ("", True), (None, True)]
    assert spark.range(1).select(parse_time(F.lit("2024-02-30 1:00:00"))).first()[0] is None
