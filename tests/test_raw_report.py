"""The whole job: raw CSV tables with text that is no date, discovered categories, a search, a report."""

import pytest
from pyspark.sql import functions as F

from hindcast.operators.models import score
from hindcast.plans import raw_report
from hindcast.sources import clinical
from hindcast.sources.tables import LABS, PATIENTS, STAGES, load_model, write_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    death = F.when(F.col("empi") % 10 == 0, F.lit("unknown")).otherwise(F.col("death_date").cast("string"))
    tables = {"patients": clinical.pat_list(spark, SF).withColumn("death_date", death).select(*PATIENTS.names),
              "labs": clinical.labs(spark, SF).select(*LABS.names), "stages": clinical.stage(spark, SF).select(*STAGES.names),
              "diagnoses": clinical.dx(spark, SF), "codes": clinical.code_map(spark, SF)}
    for name, df in tables.items():
        write_table(df.select(*[F.col(c) for c in raw_report.RAW[name].names]), f"{folder}/{name}", "csv")
    return folder


def test_raw_tables_to_report(spark, raw, tmp_path):
    raw_report.main(["-i", raw, "-o", f"{tmp_path}/out", "-k", "2"], spark, {"numTrees": [5], "maxDepth": [3]}, clinical.DRIVER_TESTS)
    model, args = load_model(spark, f"{tmp_path}/out/rf")
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    matrix, names = raw_report.training_matrix(raw_report.read_raw(spark, raw), clinical.DRIVER_TESTS)
    assert args["features"] == names and {f"STAGE_GROUP_{g}" for g in clinical.STAGE_GROUPS} <= set(names)
    rows = matrix.count()
    assert sum(r.n for r in read("rates").collect()) == rows == score(model, matrix).where("pred BETWEEN 0 AND 1").count()
    # A death date that is no date is none.
    dead = clinical.pat_list(spark, SF).where("death_date IS NOT NULL AND empi % 10 <> 0").select("empi").distinct()
    assert matrix.where("label = 1").select("empi").distinct().exceptAll(dead).count() == 0
    assert matrix.where("label = 1").count() > 0
    report = {r.group: r for r in read("report").collect()}
    assert set(report) == {"train", "test"} and report["train"].auc > 0.5
    assert read("sweep").count() == 9 and read("search").count() == 1
    top, bottom = read("top").collect(), read("bottom").collect()
    assert min(r.importance for r in top) >= max(r.importance for r in bottom) - 1e-12 or len(names) < 20
    assert read("cumulative").agg(F.max("cumulative_prop")).first()[0] == pytest.approx(1)
