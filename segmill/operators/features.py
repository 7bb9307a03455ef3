"""Customer metrics -> feature vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.operators.profile import random_sample
from segmill.schemas import CATEGORICAL_FEATURES, INTEGER_FEATURES, NUMERIC_FEATURES
from segmill.sources.tables import customers_by_id_range


def _input_sql(column: str) -> str:
    """A metric as a feature input: single precision for the measures, gaps as 0."""
    if column in INTEGER_FEATURES:
        return f"coalesce(double({column}), 0D)"
    return f"coalesce(nanvl(double(float({column})), 0D), 0D)"


def numeric_input(column: str) -> Column:
    return F.expr(_input_sql(column))


def scaling(customers: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, in one aggregate; 1 for a constant column."""
    aggregates = []
    for c in columns:
        aggregates += [F.avg(numeric_input(c)), F.stddev_pop(numeric_input(c))]
    row = customers.agg(*aggregates).first()
    found = {}
    for i, c in enumerate(columns):
        mean, deviation = row[2 * i], row[2 * i + 1]
        found[c] = (mean or 0.0, deviation or 1.0)
    return found


def _scaled_sql(column: str, mean: float, deviation: float) -> str:
    return f"({_input_sql(column)} - ({mean!r}D)) / {deviation!r}D AS {column}_z"


def scaled_features(
    customers: DataFrame,
    columns: list[str] = NUMERIC_FEATURES,
    fitted: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``id_client`` and a z-scored ``<name>_z`` per numeric column."""
    fitted = fitted or scaling(customers, columns)
    return customers.selectExpr("id_client", *[_scaled_sql(c, *fitted[c]) for c in columns])


def fit_preprocessor(
    customers: DataFrame, sample_size: int | None = None, seed: int = 0
) -> PipelineModel:
    """Scaler and one-hot encoder as one saveable pipeline.

    The scaler is fitted on the whole table, or on ``sample_size`` random
    rows; the categories always come from the whole table. A category not
    seen here, or a null, encodes to zeros.
    """
    scaled_on = customers if sample_size is None else random_sample(customers, sample_size, seed)
    fitted = scaling(scaled_on)
    statement = ", ".join(_scaled_sql(c, *fitted[c]) for c in NUMERIC_FEATURES)
    keep = ", ".join(["id_client", *CATEGORICAL_FEATURES])
    indexes = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    blocks = [f"{c}_block" for c in CATEGORICAL_FEATURES]
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT {keep}, {statement} FROM __THIS__"),
            StringIndexer(
                inputCols=CATEGORICAL_FEATURES,
                outputCols=indexes,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            # "keep" puts unknown values in a last slot, the one that is dropped
            OneHotEncoder(inputCols=indexes, outputCols=blocks, dropLast=True),
            VectorAssembler(
                inputCols=[f"{c}_z" for c in NUMERIC_FEATURES] + blocks, outputCol="features"
            ),
        ]
    ).fit(customers)


def feature_names(model: PipelineModel) -> list[str]:
    labels = model.stages[1].labelsArray
    encoded = [f"{c}_{value}" for c, values in zip(CATEGORICAL_FEATURES, labels) for value in values]
    return [*NUMERIC_FEATURES, *encoded]


def feature_matrix(customers: DataFrame, model: PipelineModel) -> DataFrame:
    """``id_client`` beside, never inside, the ``features`` vector."""
    return model.transform(customers).select("id_client", "features")


def feature_batch(customers: DataFrame, model: PipelineModel, start: int, end: int) -> DataFrame:
    """The matrix for an id range, both ends included; empty, with its schema, for an empty range."""
    return feature_matrix(customers_by_id_range(customers, start, end), model)


def one_hot_slots(customers: DataFrame, model: PipelineModel) -> DataFrame:
    """Which slot of each block is set, -1 for a zero block."""
    encoded = model.transform(customers)
    slots = [
        (F.array_position(vector_to_array(f"{c}_block"), F.lit(1.0)) - 1).cast("int").alias(f"{c}_slot")
        for c in CATEGORICAL_FEATURES
    ]
    return encoded.select("id_client", *CATEGORICAL_FEATURES, *slots)
