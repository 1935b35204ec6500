"""Clinical tables as views over the driver tables, so that every operator has input at every scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import age_years, survival_days
from hindcast.sources.tables import driver_table

# The lab tests made wide, for the clinical source tables.
LAB_TESTS = (
    "HEMATOCRIT", "HEMOGLOBIN", "WHITE BLOOD COUNT", "MCV", "PLATELET COUNT", "MCHC", "RED BLOOD CELL COUNT", "MCH",
    "POTASSIUM", "SODIUM", "CREATININE", "BUN", "GLUCOSE", "EGFR CKD-EPI CR 2021", "CHLORIDE", "CALCIUM", "CO2", "RDW",
    "TOTAL PROTEIN", "ALBUMIN", "LYMPHOCYTE", "NEUTROPHIL", "MONOCYTE", "EOSINOPHIL", "BASOPHIL",
    "ABSOLUTE MONOCYTES", "ABSOLUTE LYMPHOCYTES", "ABS NEUTROPHILS", "ABSOLUTE BASOPHILS", "ABSOLUTE EOSINOPHILS",
)

# The test names that the driver tables offer instead; STANDARD is left out, so the list does filter.
DRIVER_TESTS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
SITES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STAGE_GROUPS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
MODEL_WEIGHTS = {"rf": 0.50, "gb": 0.45, "lr": 0.40}
LAB_ORDER = ("result_time", "l_orderkey", "l_linenumber", "l_partkey", "ord_num_value", "result_flag")


def pat_list(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    after = lambda day, days: F.date_add(F.lit(day).cast("date"), days.cast("int"))
    return (
        driver_table(spark, sf, "customer").join(driver_table(spark, sf, "orders"), F.expr("c_custkey = o_custkey"))
        .select(
            key.cast("string").alias("pat_id"), key.alias("empi"), F.col("o_orderkey").alias("csn"),
            F.col("o_orderdate").cast("timestamp").alias("appt_time"),
            after("1930-01-01", key * 7919 % 20000).alias("birth_date"),
            F.when(key % 5 == 0, after("1999-01-01", key * 37 % 900)).alias("death_date"),
            (key % 2 + 1).cast("int").alias("sex_c"), F.col("c_mktsegment").alias("specialty"))
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return (
        driver_table(spark, sf, "lineitem")
        .join(driver_table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(driver_table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    )


def labs(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "High").when(F.col("l_returnflag") == "R", "Low")
    return _lines(spark, sf).select(
        F.col("o_custkey").cast("string").alias("pat_id"), F.col("o_custkey").alias("empi"),
        F.col("l_shipdate").cast("timestamp").alias("result_time"), F.col("p_type").alias("common_name"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("ord_num_value"), flag.alias("result_flag"),
        "l_orderkey", "l_linenumber", "l_partkey")


def dx(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(
        F.col("o_custkey").cast("string").alias("pat_id"),
        F.col("l_shipdate").cast("timestamp").alias("contact_date"), F.col("p_brand").alias("code"))


def stage(spark: SparkSession, sf: str) -> DataFrame:
    return (
        driver_table(spark, sf, "orders").join(driver_table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
        .select(
            F.col("o_custkey").cast("string").alias("pat_id"), F.col("o_custkey").alias("empi"),
            F.col("o_orderdate").cast("timestamp").alias("sign_datetime"), F.col("c_mktsegment").alias("body_site_name"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("stage_group"))
    )


def code_map(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substring_index("code", "#", -1).cast("int")
    return (
        driver_table(spark, sf, "part").select(F.col("p_brand").alias("code")).distinct()
        .select("code", (number % 6).cast("string").alias("comorbidity"),
                (number % 4).cast("double").alias("mortality_weight"),
                (number % 3).cast("double").alias("readmission_weight"))
    )


def _death_within(days: int) -> Column:
    gap = F.datediff("death_date", F.to_date("appt_time"))
    return F.coalesce((gap >= 0) & (gap <= days), F.lit(False)).cast("int")


def enc(spark: SparkSession, sf: str) -> DataFrame:
    """Encounters with label (death within 180 days), age and survival time."""
    return pat_list(spark, sf).withColumns({
        "label": _death_within(180), "pat_age": age_years("birth_date", "appt_time"),
        "surv": survival_days("death_date", "appt_time")})


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' scores, long: one row per encounter and model."""
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("w"))
                                 for m, w in MODEL_WEIGHTS.items()]))
    pred = F.col("m.w") * F.col("label") \
        + (F.lit(1.0) - F.col("m.w")) * uniform_text(F.col("m.model"), F.col("csn"))
    return (
        enc(spark, sf).withColumn("m", models)
        .select("csn", "empi", "pat_id", F.col("m.model").alias("model"), "label", pred.alias("pred"),
                "specialty", "pat_age", "sex_c", "surv")
    )


def uniform_text(seed: Column, key: Column) -> Column:
    """``uniform`` with a text column as seed."""
    text = F.concat_ws("|", seed, key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
