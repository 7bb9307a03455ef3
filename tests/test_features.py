from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from segmill.operators import features, profile
from segmill.schemas import NUMERIC_FEATURES


def customers(spark, n=40):
    df = spark.range(n).withColumnRenamed("id", "id_client")
    df = df.withColumns({c: (F.col("id_client") * (i + 1) % 7).cast("double") for i, c in enumerate(NUMERIC_FEATURES)})
    return df.withColumns(
        {
            "recency_days": F.lit(3.0),
            "avg_item_value": F.when(F.col("id_client") % 2 == 0, F.lit(float("nan"))).otherwise(4.0),
            "cart_to_click_ratio": F.when(F.col("id_client") % 4 == 0, F.lit(None)).otherwise(2.0),
            "most_common_category": F.element_at(F.array(F.lit("b"), F.lit("a"), F.lit("Other")), (F.col("id_client") % 3 + 1).cast("int")),
            "most_common_brand": F.lit("x"),
        }
    )


def vectors(df):
    rows = df.select("id_client", vector_to_array("features").alias("v")).orderBy("id_client").collect()
    return {r["id_client"]: r["v"] for r in rows}


def test_matrix(spark, tmp_path):
    table = customers(spark)
    model = features.fit_preprocessor(table)
    names = features.feature_names(model)
    assert names[17:] == [
        "most_common_category_Other",
        "most_common_category_a",
        "most_common_category_b",
        "most_common_brand_x",
    ]
    found = vectors(features.feature_matrix(table, model))
    assert all(len(v) == 21 for v in found.values())
    assert found[0][17:] == [0, 0, 1, 1]
    columns = list(zip(*found.values()))
    assert all(value == 0 for value in columns[names.index("recency_days")])
    for name in ("n_clicks", "avg_item_value", "cart_to_click_ratio"):
        values = columns[names.index(name)]
        mean = sum(values) / len(values)
        assert abs(mean) < 1e-9
        assert abs(sum((v - mean) ** 2 for v in values) / len(values) - 1) < 1e-9

    unseen = table.limit(2).withColumns(
        {"most_common_category": F.lit("new"), "most_common_brand": F.lit(None).cast("string")}
    )
    assert all(v[17:] == [0, 0, 0, 0] for v in vectors(features.feature_matrix(unseen, model)).values())

    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert vectors(features.feature_matrix(table, loaded)) == found


def test_batches(spark):
    table = customers(spark)
    model = features.fit_preprocessor(table, sample_size=20, seed=1)
    assert sorted(vectors(features.feature_batch(table, model, 5, 7))) == [5, 6, 7]
    empty = features.feature_batch(table, model, 500, 600)
    assert empty.columns == ["id_client", "features"] and empty.count() == 0


def test_random_sample(spark):
    table = spark.range(20_000)
    assert profile.random_sample(table, 500, seed=3).distinct().count() == 500
    assert profile.random_sample(table, 19_990, seed=3).distinct().count() == 19_990
    assert profile.random_sample(table, 30_000, seed=3).count() == 20_000
    mean = profile.random_sample(table, 5_000, seed=4).agg(F.avg("id")).first()[0]
    assert 9_500 < mean < 10_500


def test_profile(spark):
    table = customers(spark)
    found = {r["column_name"]: r["n_missing"] for r in profile.null_profile(table).collect()}
    assert found == {"avg_item_value": 20, "cart_to_click_ratio": 10}
    assert [r[0] for r in profile.distinct_categories(table, "most_common_category").collect()] == ["Other", "a", "b"]
    assert profile.preview(table).count() == 5


def test_sample_does_not_depend_on_partitions(spark):
    table = spark.range(20_000).withColumn("text", F.concat(F.lit("t"), F.col("id") % 50))
    samples = [
        sorted(profile.random_sample(table.repartition(n), 700, seed=5).collect()) for n in (1, 7, 200)
    ]
    assert samples[0] == samples[1] == samples[2] and len(samples[0]) == 700
    assert samples[0] != sorted(profile.random_sample(table, 700, seed=6).collect())
    # copies of a row and few distinct keys
    copies = spark.range(5000).select((F.col("id") % 3).alias("k"), F.lit(1).alias("v"))
    assert profile.random_sample(copies, 40, keys=["k"]).count() == 40
