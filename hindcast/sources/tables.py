"""Reading inputs, writing results, keeping feature lists, models and run arguments."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATIENTS = T.StructType([
    T.StructField("pat_id", T.StringType()), T.StructField("empi", T.LongType()),
    T.StructField("csn", T.LongType()), T.StructField("appt_time", T.TimestampType()),
    T.StructField("birth_date", T.DateType()), T.StructField("death_date", T.StringType()),
    T.StructField("sex_c", T.IntegerType()), T.StructField("specialty", T.StringType())])
LABS = T.StructType([
    T.StructField("pat_id", T.StringType()), T.StructField("empi", T.LongType()),
    T.StructField("result_time", T.TimestampType()), T.StructField("common_name", T.StringType()),
    T.StructField("ord_num_value", T.DoubleType()), T.StructField("result_flag", T.StringType())])
DIAGNOSES = T.StructType([
    T.StructField("pat_id", T.StringType()), T.StructField("contact_date", T.TimestampType()),
    T.StructField("code", T.StringType())])
STAGES = T.StructType([
    T.StructField("pat_id", T.StringType()), T.StructField("empi", T.LongType()),
    T.StructField("sign_datetime", T.TimestampType()), T.StructField("body_site_name", T.StringType()),
    T.StructField("stage_group", T.StringType())])
SCORES = T.StructType([
    T.StructField("pred_rf", T.DoubleType()), T.StructField("pred_gb", T.DoubleType()),
    T.StructField("pred_lr", T.DoubleType()), T.StructField("label", T.IntegerType())])


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Parquet or CSV with a header row.

    Without a schema, CSV types are inferred, which costs a pass over the files; ``overrides`` names columns that get
    another type.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return df.withColumns({c: F.col(c).cast(t) for c, t in (overrides or {}).items()})


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result table as Parquet, or as CSV with a header; no index column."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    else:
        writer.parquet(path)


def save_features(spark: SparkSession, features: Sequence[str], path: str) -> None:
    spark.createDataFrame(list(enumerate(features)), "pos int, feature string").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_features(spark: SparkSession, path: str) -> list[str]:
    """A saved feature list, in its order (one row per column of a model's table, so it is short)."""
    rows = spark.read.schema("pos int, feature string").json(path).orderBy("pos").collect()
    return [r.feature for r in rows]


def save_model(spark: SparkSession, model: MLWritable, path: str, args: Mapping[str, object]) -> None:
    """A fitted pipeline, and its run arguments as a one-row JSON table beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(dict(args), sort_keys=True),)], "args string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/args")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    args = spark.read.schema("args string").json(f"{path}/args").first().args
    return PipelineModel.load(f"{path}/model"), json.loads(args)
