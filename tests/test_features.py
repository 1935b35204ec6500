"""Point-in-time features on small tables that hold the edge cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hindcast.functions.columns import (
    candidate_features, category_values, cols_like, drop_columns, fill_missing, logistic_candidates, one_hot)
from hindcast.functions.scalars import age_years, flag_score, label_horizon, lenient_date, recode_flags, survival_days
from hindcast.operators import features
from hindcast.operators.asof import asof_join
from hindcast.plans import modelling
from hindcast.plans.feature_matrix import left_join_features
from hindcast.sources import clinical, tables

SF = "/root/testdata/sf0.001"
ENC = "pat_id string, empi long, csn long, appt_time timestamp, birth_date date, death_date date, sex_c int"
LAB = "pat_id string, empi long, result_time timestamp, common_name string, ord_num_value double, result_flag string"


def at(day, hour=0):
    return datetime(2020, 1, day, hour)


def encounters(spark, rows):
    return spark.createDataFrame([(p, e, c, t, date(1960, 1, 1), None, 1) for p, e, c, t in rows], ENC)


def test_same_day_events_never_count(spark):
    enc = encounters(spark, [("a", 1, 1, at(10, 9))])
    labs = spark.createDataFrame([("a", 1, t, "X", v, None) for t, v in [
        (at(9, 23), 1.0), (at(10, 8), 2.0), (at(10, 10), 3.0), (at(11), 4.0)]], LAB)
    row = features.lab_features(enc, labs, ["X"]).collect()
    assert [(r["X_MOST_RECENT_VALUE"], r["X_COUNT"]) for r in row] == [(1.0, 1)]
    assert [r.ord_num_value for r in asof_join(enc, labs, "result_time").collect()] == [1.0]


def test_last_skips_missing_and_orders_by_time(spark):
    enc = encounters(spark, [("a", 1, 1, at(10))])
    labs = spark.createDataFrame([
        ("a", 1, at(3), "X", 7.0, "Low"), ("a", 1, at(5), "X", None, "High"), ("a", 1, at(1), "X", 9.0, None),
        ("a", 1, at(6), "Y", 5.0, None), ("a", 1, at(6), "Z", 1.0, None)], LAB)
    row = features.lab_features(enc, labs, ["X", "Y", "W"]).first()
    assert (row["X_MOST_RECENT_VALUE"], row["X_MOST_RECENT_FLAG"], row["X_COUNT"]) == (7.0, "High", 3)
    assert (row["Y_MOST_RECENT_VALUE"], row["Y_MOST_RECENT_FLAG"], row["Y_COUNT"]) == (5.0, None, 1)
    assert (row["W_MOST_RECENT_VALUE"], row["W_COUNT"]) == (None, None)


def test_equal_times_take_the_greatest_value(spark):
    enc = encounters(spark, [("a", 1, 1, at(10))])
    labs = spark.createDataFrame([("a", 1, at(3), "X", v, None) for v in (2.0, 5.0, 3.0)], LAB)
    assert features.lab_features(enc, labs, ["X"]).first()["X_MOST_RECENT_VALUE"] == 5.0


def test_two_encounters_on_a_day_double_counts(spark):
    enc = encounters(spark, [("a", 1, 1, at(10, 8)), ("a", 1, 2, at(10, 15)), ("a", 1, 3, at(12))])
    labs = spark.createDataFrame([("a", 1, at(3), "X", 1.0, None), ("a", 1, at(11), "X", 1.0, None)], LAB)
    count = lambda **kw: {r.appt_date.day: r["X_COUNT"]
                          for r in features.lab_features(enc, labs, ["X"], **kw).collect()}
    assert count() == {10: 2, 12: 2}
    assert count(dedupe_encounters=True) == {10: 1, 12: 2}
    assert features.demographics(enc).count() == 2


def test_labs_and_stages_in_one_window(spark):
    """Rows before an encounter in either table, both, none, and on its own day; the training table runs one window for both."""
    enc = encounters(spark, [("a", 1, 1, at(10, 8)), ("a", 1, 2, at(10, 15)), ("b", 2, 3, at(5)), ("c", 3, 4, at(5)),
                             ("d", 4, 5, at(5)), ("a", 1, 6, at(2)), (None, 5, 7, at(9)), ("e", 6, 8, None)]) \
        .withColumn("specialty", F.lit("P"))
    labs = spark.createDataFrame([("a", 1, at(3), "X", 1.0, None), ("a", 1, at(6), "X", None, "Low"),
                                  ("a", 1, at(10), "X", 5.0, None), ("b", 2, at(1), "Y", 2.0, None), ("e", 6, at(1), "X", 3.0, None)], LAB)
    stage = spark.createDataFrame([("a", 1, at(4), "P", "1"), ("a", 1, at(9), "Q", "2"), ("c", 3, at(1), "P", None),
                                   ("c", 3, at(5), "P", None), ("b", 2, at(4), None, "1")], tables.STAGES)
    both = features.lab_and_stage_features(enc, labs, stage, ["X", "Y"], {"body_site_name": ["P", "Q"]}, prefixes={"body_site_name": "n_"})
    key = ["pat_id", "empi", "appt_date"]
    apart = features.lab_features(enc, labs, ["X", "Y"]).join(
        features.stage_features(enc, stage, {"body_site_name": ["P", "Q"]}, {"body_site_name": "n_"}), key, "full")
    assert sorted(map(str, both.select(apart.columns).collect())) == sorted(map(str, apart.collect())) and apart.count() == 3
    wide = modelling.encounter_features(enc, labs, stage, ["X", "Y"], ["P", "Q"], ["P"], ["result_time"])
    got = {r.csn: (r["X: last"], r["X: count"], r["Y: count"], r.n_P, r.n_Q) for r in wide.collect()}
    assert got == {1: (1, 4, 0, 2, 2), 2: (1, 4, 0, 2, 2), 3: (0, 0, 1, 0, 0), 4: (0, 0, 0, 1, 0), 5: (0, 0, 0, 0, 0),
                   6: (0, 0, 0, 0, 0), 7: (0, 0, 0, 0, 0), 8: (0, 0, 0, 0, 0)}
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1


def test_missing_keys_and_dates_match_nothing(spark):
    enc = encounters(spark, [(None, 1, 1, at(10)), ("a", None, 2, at(10)), ("a", 1, 3, None), ("a", 1, 4, at(10))])
    labs = spark.createDataFrame([(None, 1, at(1), "X", 1.0, None), ("a", None, at(1), "X", 1.0, None),
                                  ("a", 1, None, "X", 1.0, None), ("a", 1, at(2), "X", 8.0, None)], LAB)
    assert [r["X_COUNT"] for r in features.lab_features(enc, labs, ["X"]).collect()] == [1]
    assert asof_join(enc, labs, "result_time").count() == 1


def test_stage_counts_and_missing_categories(spark):
    enc = encounters(spark, [("a", 1, 1, at(10))])
    stage = spark.createDataFrame(
        [("a", 1, at(1), "LUNG", "I"), ("a", 1, at(2), "LUNG", None), ("a", 1, at(20), "SKIN", "II")],
        "pat_id string, empi long, sign_datetime timestamp, body_site_name string, stage_group string")
    row = features.stage_features(enc, stage, {"body_site_name": ["LUNG", "SKIN"], "stage_group": ["I", "II"]}).first()
    assert (row.BODY_SITE_NAME_LUNG, row.BODY_SITE_NAME_SKIN, row.STAGE_GROUP_I, row.STAGE_GROUP_II) == (2, 0, 1, 0)


def test_codes_and_comorbidities(spark):
    enc = encounters(spark, [("a", 1, 1, at(10)), ("a", 2, 2, at(5)), ("b", 3, 3, at(10))])
    dx = spark.createDataFrame(
        [("a", at(1), "c1"), ("a", at(2), "c1"), ("a", at(6), "c2"), ("a", at(3), None), ("b", at(1), "zz")],
        "pat_id string, contact_date timestamp, code string")
    codes = {(r.pat_id, r.empi): r.aggregated_codes for r in features.dx_codes(enc, dx).collect()}
    assert codes == {("a", 1): ["c1", "c1", "c2"], ("a", 2): ["c1", "c1"], ("b", 3): ["zz"]}
    table = spark.createDataFrame([("c1", "heart", 2.0, 1.0), ("c3", "heart", 2.0, 1.0), ("c2", "lung", 5.0, -1.0),
                                   ("c9", "none", 1.0, 1.0)],
                                  "code string, comorbidity string, mortality_weight double, readmission_weight double")
    got = {(r.pat_id, r.empi): (r.cmrbdt_heart, r.cmrbdt_lung, r.cmrbdt_none, r.mrtlt_scr, r.rdmsn_scr)
           for r in features.comorbidity_features(enc, dx, table).collect()}
    assert got == {("a", 1): (1, 1, 0, 7.0, 0.0), ("a", 2): (1, 0, 0, 2.0, 1.0), ("b", 3): (0, 0, 0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        features.comorbidity_features(enc, dx, table, max_groups=2)


def test_pair_join_agrees_with_running_form_also_when_split(spark):
    """One patient holds a third of all events; splitting them changes nothing."""
    pats = clinical.pat_list(spark, SF)
    labs = clinical.labs(spark, SF).withColumn("empi", F.expr("if(pmod(l_linenumber, 3) = 0, 1, empi)")) \
        .withColumn("pat_id", F.col("empi").cast("string"))
    key = ["pat_id", "empi", "appt_date"]
    running = features.asof_digest(pats, labs, "result_time", "ord_num_value").select(*key, "n_events", "sum_value")
    for hot_rows in (1_000_000, 100):
        pairs = asof_join(pats, labs, "result_time", hot_rows=hot_rows).groupBy(*key).agg(
            F.count(F.lit(1)).alias("n_events"), F.sum("ord_num_value").alias("sum_value"))
        assert pairs.exceptAll(running).count() == 0 and running.exceptAll(pairs).count() == 0


def test_colliding_names_get_the_suffix(spark):
    base = spark.createDataFrame([("a", 1, date(2020, 1, 1), 5)], "pat_id string, empi long, appt_date date, x int")
    other = base.withColumn("x", F.lit(7))
    assert left_join_features(base, {"_lab": other}).first().asDict()["x_lab"] == 7


def test_scalar_edges(spark):
    df = spark.createDataFrame([Row(i=i, s=s) for i, s in enumerate(["2020-13-01", "", "bad", None, "2020-02-03"])])
    assert [r.d for r in df.orderBy("i").select(lenient_date("s").alias("d")).collect()] == \
        [None, None, None, None, date(2020, 2, 3)]
    ages = spark.createDataFrame([(1, date(2020, 1, 2), date(2020, 1, 1)), (2, date(2019, 1, 1), date(2020, 1, 1)),
                                  (3, date(2019, 1, 2), date(2020, 1, 1))], "i int, b date, a date")
    assert [r.age for r in ages.orderBy("i").select(age_years("b", "a").alias("age")).collect()] == [-1, 1, 0]
    times = spark.createDataFrame(
        [(1, None, at(1)), (2, at(1), at(2)), (3, at(2), at(1)), (4, at(2, 12), at(1))],
        "i int, d timestamp, a timestamp")
    got = [tuple(r) for r in times.orderBy("i").select(survival_days("d", "a"), label_horizon("d", "a", 1)).collect()]
    assert got == [(float("inf"), 0), (float("inf"), 1), (1.0, 0), (1.5, 0)]


def test_flags(spark):
    df = spark.createDataFrame([(1, "Low Panic"), (2, "Low"), (3, "High"), (4, "High Panic"), (5, None), (6, "odd")],
                               "i int, x_FLAG string")
    assert [r[1] for r in recode_flags(df).orderBy("i").collect()] == [0.25, 0.5, 0.75, 1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="unknown flag"):
        df.select(flag_score("x_FLAG", strict=True)).collect()


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, "b", None)],
                               "`Unnamed: 0` int, n_x int, `HGB: last` int, `s>>>v` int, pat_age int, t string, u string")
    assert cols_like(df, starts="n_") == ["n_x"] and cols_like(df, contains=">>>") == ["s>>>v"]
    assert candidate_features(df) == ["n_x", "Unnamed: 0", "HGB: last", "s>>>v", "pat_age"]
    assert logistic_candidates(["HGB: last", "n_x", "Hn_y", "pat_age", "HGB: count"]) == \
        ["HGB: last", "n_x", "Hn_y", "pat_age"]
    assert drop_columns(df, ["n_x", "not there"]).columns == ["HGB: last", "s>>>v", "pat_age", "t", "u"]
    assert fill_missing(df).first().u == "0"
    three = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "t string")
    assert one_hot(three, ["t"], drop_first=True).columns == ["t_b", "t_c"]
    with pytest.raises(ValueError):
        category_values(three, "t", limit=2)


def test_feature_list_and_csv_round_trip(spark, tmp_path):
    tables.save_features(spark, ["z: last", "a", "m>>>x"], f"{tmp_path}/f")
    assert tables.load_features(spark, f"{tmp_path}/f") == ["z: last", "a", "m>>>x"]
    df = spark.createDataFrame([("007", 1)], "pat_id string, x int")
    tables.write_table(df, f"{tmp_path}/t", "csv")
    back = tables.read_table(spark, f"{tmp_path}/t", overrides={"pat_id": "string"})
    assert back.schema["pat_id"].dataType.simpleString() == "string" and back.first().x == 1


def test_discovered_categories(spark):
    encs = spark.createDataFrame([("p", 1, 1, "2024-05-01 10:00:00")], "pat_id string, empi long, csn long, appt_time string") \
        .withColumn("appt_time", F.col("appt_time").cast("timestamp"))
    rows = [("p", 1, "2024-01-0%d 00:00:00" % (1 + i % 9), v, None if i % 2 else "II") for i, v in enumerate(["lung", "new", None, "lung"])]
    stage = spark.createDataFrame(rows, "pat_id string, empi long, sign_datetime string, site string, grp string") \
        .withColumn("sign_datetime", F.col("sign_datetime").cast("timestamp"))
    found = features.stage_features_discovered(encs, stage, ["site", "grp"]).first().asDict()
    assert {k: v for k, v in found.items() if "_" in k and k[0].isupper()} == {"SITE_lung": 2, "SITE_new": 1, "GRP_II": 2}
    with pytest.raises(ValueError, match="more than 2"):
        features.stage_features_discovered(encs, stage, ["site", "grp"], max_values=2)


def test_code_map_of_a_patient_with_most_codes(spark):
    encs = spark.createDataFrame([(p, i, i, "2024-05-01 10:00:00") for i, p in enumerate("abc")],
                                 "pat_id string, empi long, csn long, appt_time string") \
        .withColumn("appt_time", F.col("appt_time").cast("timestamp"))
    dx = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN 'a' ELSE 'b' END AS pat_id", "concat('c', id % 4) AS code",
                                      "CAST(timestampadd(MINUTE, id, TIMESTAMP '2024-01-01') AS TIMESTAMP) AS contact_date")
    maps = {r.pat_id: r.codes for r in features.dx_code_map(encs, dx).collect()}
    assert maps == {"a": {f"c{i}": 1000 for i in range(4)}, "b": {f"c{i}": 500 for i in range(4)}}
    lists = {r.pat_id: r.aggregated_codes for r in features.dx_codes(encs, dx).collect()}
    assert lists["b"] == sorted(["c0", "c1", "c2", "c3"] * 500)


def test_text_that_is_no_date_is_no_death(spark):
    rows = [("p", 1, "not a date"), ("p", 1, ""), ("q", 2, "2024-02-30"), ("q", 2, None), ("r", 3, "2024-02-29"), ("r", 3, "x")]
    pats = spark.createDataFrame(rows, "pat_id string, empi long, death_date string")
    assert {r.pat_id: r.dead for r in features.mortality_flag(pats).collect()} == {"p": 0, "q": 0, "r": 1}
