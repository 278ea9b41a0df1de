"""Plan properties that matter at scale, read from the physical plans."""

import pytest
from conftest import SF01

from notewise.plans.catalog import load_all

REG = load_all()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXT_PATH = ["clean_text", "tokenize", "word_length", "remove_stopwords", "word_count_custom",
             "keyword_filter", "label_cohort", "case_control_cohort", "cohort_match"]


@pytest.mark.parametrize("name", TEXT_PATH)
def test_text_path_stays_in_the_jvm(spark, name):
    p = plan_of(REG[name].fn(spark, SF01))
    for python_node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert python_node not in p, name


NO_PAIRS = ["label_cohort", "case_control_cohort", "sample_negatives", "split_random", "split_stratified",
            "split_three_way", "split_by_group", "undersample_majority", "pr_curve", "roc_auc",
            "best_threshold", "cohort_match_bounded", "leaderboard", "smote_neighbors", "smote_oversample",
            "length_histogram", "threshold_sweep", "classification_report"]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cartesian_or_nested_loop_joins(spark, name):
    p = plan_of(REG[name].fn(spark, SF01))
    assert "CartesianProduct" not in p, name
    assert "BroadcastNestedLoopJoin" not in p, name


def test_scan_reads_only_needed_columns(spark):
    p = plan_of(REG["keyword_filter"].fn(spark, SF01))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p
    p = plan_of(REG["sigmoid"].fn(spark, SF01))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p


def test_domain_filter_is_pushed_to_the_scan(spark):
    p = plan_of(REG["domain_filter"].fn(spark, SF01))
    assert "PushedFilters: [In(label, [0,1])]" in p


def test_stream_equals_batch(spark):
    stream = {r.subject_id for r in REG["stream_cohort"].fn(spark, SF01).collect()}
    from notewise.functions.text import contains_any
    from notewise.sources.tables import table
    ev = table(spark, SF01, "events")
    batch = {r.user_id for r in ev.where(contains_any("event_type", ["PURCH"])).select("user_id").distinct().collect()}
    assert stream == batch and len(stream) == 150


@pytest.mark.parametrize("name", ["label_cohort", "pr_curve", "leaderboard", "smote_neighbors",
                                  "undersample_majority", "cohort_match_bounded", "word_count_custom"])
def test_results_do_not_depend_on_partition_count(spark, name):
    from oracle import rows_of
    out = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = REG[name].fn(spark, SF01)
            out.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


ROW_LEVEL = ["label_cohort", "case_control_cohort", "cohort_match_bounded", "split_three_way",
             "undersample_majority", "pr_curve", "roc_auc", "best_threshold", "classification_report",
             "leaderboard", "length_histogram", "word_weights", "describe_numeric", "smote_oversample"]


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_single_partition_exchanges_only_over_small_tables(spark, name):
    """Whatever funnels into one task must be a partial aggregate (one row per
    task), a bucket-count table (at most strata x 65536 rows) or the
    boundary-bucket units of an exact-k cut (about n / 65536)."""
    lines = plan_of(REG[name].fn(spark, SF01)).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        child = lines[i + 1].strip().lstrip(":+- ").lstrip("*(0123456789) ")
        ok = (child.startswith(("HashAggregate", "SortAggregate", "ObjectHashAggregate"))
              or child.startswith(("Project [_u", "Window [sum(_c")))
        assert ok, f"{name}: {child[:120]}"


def test_checked_broadcast_falls_back_to_a_shuffle_join(spark):
    from pyspark.sql import functions as F

    from notewise.session import broadcast_if_small
    big = spark.range(50_000).select((F.col("id") % 1000).alias("k"), "id")
    small = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(broadcast_if_small(small, max_rows=10_000), "k")
        plain = big.join(broadcast_if_small(small, max_rows=10), "k")
        assert "BroadcastHashJoin" in plan_of(hinted)
        assert "BroadcastHashJoin" not in plan_of(plain)
        assert hinted.agg(F.sum("v")).first()[0] == plain.agg(F.sum("v")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
