from pyspark.sql import functions as F

from segmill.operators import enrich, skew


def hot_rows(spark, n=200_000):
    """Two thirds of the rows share one key, half of these being exact copies."""
    n_hot = 2 * n // 3
    key = F.when(F.col("id") < n_hot, F.lit(0)).otherwise(F.col("id"))
    value = F.when(F.col("id") < n_hot // 2, F.lit(1)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 16).select(key.alias("k"), value.alias("v"))


def totals_of(rows):
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))


def test_same_as_a_window(spark):
    rows = hot_rows(spark, 30_000)
    got = skew.join_totals(rows, totals_of(rows), ["k"], ["top"])
    from pyspark.sql import Window

    expected = rows.withColumn("top", F.max("v").over(Window.partitionBy("k")))
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_a_given_count_changes_nothing(spark):
    rows = hot_rows(spark, 30_000)
    given = skew.join_totals(rows, totals_of(rows), ["k"], ["top"], n_rows=rows.count())
    counted = skew.join_totals(rows, totals_of(rows), ["k"], ["top"])
    assert given.exceptAll(counted).isEmpty() and counted.exceptAll(given).isEmpty()


def test_null_keys_are_a_group(spark):
    rows = spark.createDataFrame([(None, 1), (None, 5), (2, 3)], "k long, v long")
    got = skew.join_totals(rows, totals_of(rows), ["k"], ["top"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 5), (3, 3), (5, 5)]


def test_a_hot_group_is_spread_over_the_tasks(spark):
    rows = hot_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = skew.join_totals(rows, totals_of(rows), ["k"], ["top"])
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 200_000
    assert len(sizes) == 8
    assert max(sizes) < 2 * 200_000 / 8


def test_only_hot_groups_are_broadcast(spark):
    rows = hot_rows(spark)
    hot = totals_of(rows).where(skew.is_hot(F.lit(rows.count())))
    assert [r["k"] for r in hot.collect()] == [0]


def test_totals_are_shuffled_once(spark):
    rows = hot_rows(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = skew.join_totals(rows, totals_of(rows), ["k"], ["top"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan


def test_enrichment_has_no_window(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "view", 1, "b", 1.0, 1, "s", "c")],
        "t string, event_type string, product_id long, brand string, price double, user_id long, "
        "user_session string, category_code_1 string",
    ).withColumn("event_time", F.col("t").cast("timestamp"))
    for operator in (enrich.with_value_counts, enrich.with_product_totals, enrich.with_session_bounds):
        assert "Window" not in operator(df)._jdf.queryExecution().executedPlan().toString()
