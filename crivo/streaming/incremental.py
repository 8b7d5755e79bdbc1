"""The additive aggregates and the carried model, fed file by file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from crivo.operators.contingency import _number, quoted, with_totals
from crivo.operators.logit import _design, _zeros, updated_weights


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_step: int | None = 1, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a few files per step, or all new ones."""
    reader = spark.readStream.schema(schema)
    if files_per_step:
        reader = reader.option("maxFilesPerTrigger", files_per_step)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def running_class_sums(stream: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Running sums by class, one wide row per class: the state is classes x features."""
    return (
        stream.where(quoted(target).isNotNull())
        .groupBy(quoted(target).alias("class"))
        .agg(
            F.count(F.lit(1)).alias("n_class"),
            *[F.coalesce(F.sum(_number(stream, c)), F.lit(0.0)).alias(c) for c in features],
        )
    )


def running_cells(stream: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Running contingency counts: ``feature, value, class, o``."""
    texts = [quoted(c).cast("string").alias(c) for c in features]
    long = (
        stream.where(quoted(target).isNotNull())
        .select(quoted(target).alias("_class"), *texts)
        .unpivot("_class", [quoted(c) for c in features], "feature", "value")
        .where(F.col("value").isNotNull())
    )
    return long.groupBy("feature", "value", F.col("_class").alias("class")).agg(F.count(F.lit(1)).alias("o"))


def run_to_table(running: DataFrame, path: str) -> DataFrame:
    """Process everything new and give the running aggregate as it then is.

    Every step writes the whole state as Parquet to ``path/step=i``. A later call with the
    same ``path`` goes on from the state before it, with the files that came since.
    """
    spark = running.sparkSession

    def step(state: DataFrame, number: int) -> None:
        state.write.mode("overwrite").parquet(f"{path}/step={number}")

    query = (
        running.writeStream.outputMode("complete").foreachBatch(step)
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*running.schema.fields, T.StructField("step", T.IntegerType())])
    steps = spark.read.schema(schema).parquet(path)
    return steps.where(F.col("step") == steps.agg(F.max("step").alias("step")).scalar()).drop("step")


def long_class_sums(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """The wide running sums as the class-sum frame that the scores take."""
    long = wide.unpivot(["class", "n_class"], [quoted(c) for c in features], "feature", "o")
    return with_totals(long.select("feature", "class", "o", "n_class"), ["feature"])


def train_on_stream(
    stream: DataFrame,
    features: Sequence[str],
    target: str,
    model_path: str,
    lr: float = 0.1,
    l2: float = 1e-4,
) -> StreamingQuery:
    """Carry one logistic model over the steps of a stream.

    The weights after step ``i`` are written to ``model_path/step=i``. A repeated step
    starts from the weights before it and overwrites its own folder, so restarts give
    the same model.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if number == 0:
            before = spark.range(1).select(_zeros(len(features)).alias("w"))
        else:
            before = spark.read.parquet(f"{model_path}/step={number - 1}")
        part = _design(batch.withColumn("_all", F.lit("")), features, target, "_all")
        after = updated_weights(part, before, len(features), lr, l2)
        # A step without rows leaves the model as it is.
        kept = after.select(F.coalesce("w", before.select("w").scalar()).alias("w"))
        kept.write.mode("overwrite").parquet(f"{model_path}/step={number}")

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{model_path}/_checkpoint")
        .trigger(availableNow=True).start()
    )


def latest_weights(spark: SparkSession, model_path: str) -> DataFrame:
    """The weights after the last step."""
    steps = spark.read.parquet(model_path)
    return steps.orderBy(F.col("step").desc()).limit(1).select("w")
