"""Saved splits, scalers, metrics, histories and trials, as Spark tables in open formats.

All are written as versions (see ``versions``): a table is there before, during and after it is replaced.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.forecast import HISTORY_SCHEMA
from panelcast.operators.tuning import TRIAL_SCHEMA
from panelcast.sources import versions
from panelcast.spec import PanelSpec

METRICS_SCHEMA = (
    "mode string, model string, n bigint, mse double, rmse double, mae double, r2 double, smape double, bias double, "
    "log_likelihood double, mape double, avg_loss_transformed double"
)


def exists(spark: SparkSession, path: str) -> bool:
    if versions.latest(spark, path)[0]:
        return True
    try:
        spark.read.format("text").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the table is there and, if it is a folder, its writing ended."""
    if versions.latest(spark, path)[0]:
        return True
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return False
    return files.getFileStatus(hadoop).isFile() or files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def write_split(split: DataFrame, path: str, spec: PanelSpec) -> None:
    versions.write(split.select(*spec.unit, "split"), path, "csv", header=True)


def read_split(spark: SparkSession, path: str, spec: PanelSpec) -> DataFrame:
    """The saved table; global ids written as decimals, like ``11.0``, are read as whole numbers."""
    keys = [T.StructField(c, T.LongType()) for c in spec.pair]
    texts = [T.StructField(c, T.StringType()) for c in (spec.global_id, "split")]
    saved = versions.read(spark, path, "csv", T.StructType([*keys, *texts]), header=True)
    whole = F.col(spec.global_id).try_cast("bigint")
    decimal = F.col(spec.global_id).try_cast("double").try_cast("bigint")
    return saved.withColumn(spec.global_id, F.coalesce(whole, decimal))


def write_scaler(scaler: DataFrame, path: str) -> None:
    versions.write(scaler, path, "parquet")


def read_scaler(spark: SparkSession, path: str, spec: PanelSpec) -> DataFrame:
    fields = [T.StructField(f"{s}_{c}", T.DoubleType()) for c in spec.statics for s in ("mean", "std")]
    return versions.read(spark, path, "parquet", T.StructType(fields))


def write_metrics(records: DataFrame, path: str, spec: PanelSpec) -> None:
    """One folder per target mode and model, so that each can be written or replaced alone."""
    versions.write(records.withColumn("mode", F.lit(spec.mode)), path, "json", ("mode", "model"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, "json", METRICS_SCHEMA)


def write_history(history: DataFrame, path: str) -> None:
    """One folder per model; a new run of a model replaces its history."""
    versions.write(history, path, "json", ("model",))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, "json", HISTORY_SCHEMA)


def write_trials(trials: DataFrame, path: str) -> None:
    """One folder per model; a new search of a model replaces its trials."""
    versions.write(trials, path, "json", ("model_type",))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, "json", TRIAL_SCHEMA)


def write_best_params(best: DataFrame, path: str) -> None:
    """One folder per model, replaced when the model is tuned again."""
    versions.write(best, path, "json", ("model_type",))


def read_best_params(spark: SparkSession, models: list[str], combined: str,
                     per_model: dict[str, str]) -> DataFrame:
    """Best parameters of each model, null where there are none.

    The combined table is used if it covers every model, else each model's own table.
    """
    schema = TRIAL_SCHEMA
    wanted = spark.createDataFrame([(m,) for m in models], "model_type string")

    def of_models(found: DataFrame) -> DataFrame:
        return wanted.join(found.select("model_type", "hyperparameters"), "model_type", "left")

    if exists(spark, combined):
        found = versions.read(spark, combined, "json", schema)
        covered = found.filter(F.col("model_type").isin(models)).select("model_type").distinct().count()
        if covered == len(set(models)):
            return of_models(found)
    parts = [
        versions.read(spark, per_model[m], "json", schema).withColumn("model_type", F.lit(m))
        for m in models
        if m in per_model and exists(spark, per_model[m])
    ]
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    return of_models(found)


def read_actual_vs_predicted(spark: SparkSession, models: list[str], path: str, spec: PanelSpec) -> DataFrame:
    keys = ", ".join(f"{c} bigint" for c in spec.unit)
    values = ", ".join(f"{c} double" for c in (f"true_{spec.target}", *[f"{m}_prediction" for m in models]))
    schema = f"{keys}, is_test boolean, timestep bigint, {values}"
    return versions.read(spark, path, "csv", schema, header=True)


def write_actual_vs_predicted(table: DataFrame, path: str) -> None:
    versions.write(table, path, "csv", header=True)
