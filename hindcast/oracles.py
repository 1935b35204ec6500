"""The same results in plain SQL for another engine, written from the definitions: joins and filters over whole tables,
no shared logic with the Spark side."""

from __future__ import annotations

import math

from hindcast.sources.clinical import DRIVER_TESTS, SITES, STAGE_GROUPS

# The 32-bit hash by two shift-multiply steps and a shift, and its step from replicate to replicate.
MASK32, MIX_STEPS, MIX_LAST_SHIFT, REPLICATE_STEP = 2**32 - 1, ((16, 0x7FEB352D), (15, 0x31848BAB)), 14, 2654435
PICK = "b, '|', pick"

ORACLES: dict[str, str] = {}
TESTS_SQL = ", ".join(f"'{t}'" for t in DRIVER_TESTS)
METRIC_COUNTS = """
count(*) FILTER (WHERE NOT hit AND label = 0) AS tn, count(*) FILTER (WHERE hit AND label = 0) AS fp,
count(*) FILTER (WHERE NOT hit AND label = 1) AS fn, count(*) FILTER (WHERE hit AND label = 1) AS tp"""


def u(seed: object, key: str) -> str:
    seed = f"'{seed}'" if isinstance(seed, int) else seed
    return f"(('0x' || substr(md5(concat({seed}, '|', {key})), 1, 13))::BIGINT / power(2::DOUBLE, 52))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0::DOUBLE AS {name}"


VIEWS = {
    "pat_list": """
        SELECT CAST(c_custkey AS VARCHAR) AS pat_id, c_custkey AS empi, o_orderkey AS csn, o_orderdate AS appt_time,
            DATE '1930-01-01' + CAST(c_custkey * 7919 % 20000 AS INT) AS birth_date,
            CASE WHEN c_custkey % 5 = 0 THEN DATE '1999-01-01' + CAST(c_custkey * 37 % 900 AS INT) END AS death_date,
            CAST(c_custkey % 2 + 1 AS INT) AS sex_c, c_mktsegment AS specialty
        FROM customer JOIN orders ON c_custkey = o_custkey""",
    "lines": """
        SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "labs": """
        SELECT CAST(o_custkey AS VARCHAR) AS pat_id, o_custkey AS empi, l_shipdate AS result_time,
            p_type AS common_name, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS ord_num_value,
            CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'R' THEN 'Low' END AS result_flag,
            l_orderkey, l_linenumber, l_partkey FROM lines""",
    "dx": "SELECT CAST(o_custkey AS VARCHAR) AS pat_id, l_shipdate AS contact_date, p_brand AS code FROM lines",
    "stage": """
        SELECT CAST(o_custkey AS VARCHAR) AS pat_id, o_custkey AS empi, o_orderdate AS sign_datetime,
            c_mktsegment AS body_site_name,
            CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS stage_group
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "code_map": """
        SELECT code, CAST(k % 6 AS VARCHAR) AS comorbidity, k % 4 AS mortality_weight, k % 3 AS readmission_weight
        FROM (SELECT DISTINCT p_brand AS code, CAST(split_part(p_brand, '#', 2) AS INT) AS k FROM part)""",
    "enc": """
        SELECT *, CAST(coalesce(death_date >= CAST(appt_time AS DATE)
                AND date_diff('day', CAST(appt_time AS DATE), death_date) <= 180, false) AS INT) AS label,
            CAST(floor(date_diff('day', birth_date, CAST(appt_time AS DATE)) / 365.0) AS INT) AS pat_age,
            CASE WHEN death_date IS NULL OR death_date < appt_time THEN 'infinity'::DOUBLE
                ELSE (epoch_us(CAST(death_date AS TIMESTAMP)) - epoch_us(appt_time)) / 8.64e10::DOUBLE END AS surv
        FROM pat_list""",
    "scores": f"""
        SELECT csn, empi, pat_id, model, label,
            w * label + (1 - w) * {u('model', 'csn')} AS pred, specialty, pat_age, sex_c, surv
        FROM enc, (VALUES ('rf', 0.5::DOUBLE), ('gb', 0.45::DOUBLE), ('lr', 0.4::DOUBLE)) m(model, w)""",
    "cohort": f"""
        SELECT *, CASE WHEN {u(123456, 'empi')} < 0.7 THEN 'train' ELSE 'test' END AS "group" FROM (
            SELECT *, row_number() OVER (PARTITION BY empi ORDER BY {u(123456, 'csn')}, csn) AS pick FROM enc)
        WHERE pick = 1""",
    "lab_pairs": f"""
        SELECT p.pat_id, p.empi, p.csn, CAST(appt_time AS DATE) AS appt_date, labs.* EXCLUDE (pat_id, empi)
        FROM pat_list p LEFT JOIN labs ON p.pat_id = labs.pat_id AND p.empi = labs.empi
        WHERE CAST(result_time AS DATE) < CAST(appt_time AS DATE)""",
    "dx_pairs": """
        SELECT p.pat_id, p.empi, p.csn, CAST(appt_time AS DATE) AS appt_date, contact_date, code
        FROM pat_list p LEFT JOIN dx ON p.pat_id = dx.pat_id
        WHERE CAST(contact_date AS DATE) < CAST(appt_time AS DATE)""",
    "stage_pairs": """
        SELECT p.pat_id, p.empi, p.csn, CAST(appt_time AS DATE) AS appt_date, sign_datetime, body_site_name, stage_group
        FROM pat_list p LEFT JOIN stage ON p.pat_id = stage.pat_id AND p.empi = stage.empi
        WHERE CAST(sign_datetime AS DATE) < CAST(appt_time AS DATE)""",
    "line_long": """
        SELECT feature, value, label FROM (
            SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem)
        UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))""",
    "mi": """
        SELECT feature, sum(n / total * ln(n * total / (nb * nl))) AS score FROM (
            SELECT feature, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY feature, bin) AS DOUBLE) AS nb,
                CAST(sum(n) OVER (PARTITION BY feature, label) AS DOUBLE) AS nl,
                CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS total
            FROM (SELECT feature, label, len(list_filter(edges, lambda e : e < value)) AS bin, count(*) AS n
                  FROM line_long JOIN (
                      SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))
                          AS edges FROM line_long GROUP BY feature) USING (feature)
                  GROUP BY ALL))
        GROUP BY feature""",
    "auc": """
        SELECT a.model, sum(a.n * b.n * CASE WHEN a.pred > b.pred THEN 1 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END)
            / (sum(a.n * b.n)) AS auc
        FROM (SELECT model, pred, CAST(count(*) AS DOUBLE) AS n FROM scores WHERE label = 1 GROUP BY ALL) a
        JOIN (SELECT model, pred, CAST(count(*) AS DOUBLE) AS n FROM scores WHERE label = 0 GROUP BY ALL) b USING (model)
        GROUP BY a.model""",
    "ap": """
        SELECT model, sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) AS average_precision FROM (
            SELECT model, CAST(pos AS DOUBLE) AS pos,
                sum(pos) OVER (PARTITION BY model ORDER BY pred DESC) AS cum_pos,
                sum(neg) OVER (PARTITION BY model ORDER BY pred DESC) AS cum_neg
            FROM (SELECT model, pred, count(*) FILTER (WHERE label = 1) AS pos,
                      count(*) FILTER (WHERE label = 0) AS neg FROM scores GROUP BY ALL))
        GROUP BY model""",
}
NEEDS = {
    "labs": ["lines"], "dx": ["lines"], "enc": ["pat_list"], "scores": ["enc"], "cohort": ["enc"],
    "lab_pairs": ["pat_list", "labs"], "dx_pairs": ["pat_list", "dx"], "stage_pairs": ["pat_list", "stage"],
    "mi": ["line_long"], "auc": ["scores"], "ap": ["scores"],
}


def _order(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        _order(NEEDS.get(n, []), seen)
        if n not in seen:
            seen.append(n)
    return seen


def add(name: str, views: str, body: str, extra: dict[str, str] | None = None) -> None:
    parts = [f"{v} AS ({VIEWS[v]})" for v in _order(views.split(), [])]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


RATES = {
    "accuracy": div("tp + tn", "tn + fp + fn + tp"), "base_rate": div("tp + fn", "tn + fp + fn + tp"),
    "f1": f"coalesce({div('2 * tp', '2 * tp + fp + fn')}, 0)", "fpr": div("fp", "tn + fp"), "fnr": div("fn", "fn + tp"),
    "alert_rate": div("fp + tp", "tn + fp + fn + tp"), "specificity": div("tn", "tn + fp"),
    "sensitivity": div("tp", "fn + tp"), "ppv": div("tp", "fp + tp"), "npv": div("tn", "tn + fn")}
CALC_RATES = {
    "proportion_positive": div("fp + tp", "tn + fp + fn + tp"), "accuracy": RATES["accuracy"], "f1": RATES["f1"],
    "false_discovery_rate": div("fp", "fp + tp"), "false_omission_rate": div("fn", "fn + tn"),
    "specificity": RATES["specificity"], "sensitivity": RATES["sensitivity"], "ppv": RATES["ppv"],
    "npv": RATES["npv"]}
FULL = "tn, fp, fn, tp, tn + fp + fn + tp AS n, " + ", ".join(r(e, k) for k, e in RATES.items())
CALC = "tn, fp, fn, tp, " + ", ".join(r(e, k) for k, e in CALC_RATES.items())


def at_cut(cut: str, op: str = ">=", by: str = "model", source: str = "scores") -> str:
    return f"SELECT {by}, {METRIC_COUNTS} FROM (SELECT *, pred {op} {cut} AS hit FROM {source}) GROUP BY {by}"


def grid(n: int, hi: str, op: str) -> str:
    """Confusion counts at n thresholds by comparing every distinct score with every threshold."""
    return f"""
        SELECT model, threshold,
            CAST(sum(CASE WHEN NOT hit THEN neg ELSE 0 END) AS BIGINT) AS tn,
            CAST(sum(CASE WHEN hit THEN neg ELSE 0 END) AS BIGINT) AS fp,
            CAST(sum(CASE WHEN NOT hit THEN pos ELSE 0 END) AS BIGINT) AS fn,
            CAST(sum(CASE WHEN hit THEN pos ELSE 0 END) AS BIGINT) AS tp
        FROM (SELECT *, pred {op} threshold AS hit FROM (
            SELECT c.*, CASE WHEN i = {n - 1} THEN hi ELSE 0::DOUBLE + i * (hi / {n - 1}::DOUBLE) END AS threshold
            FROM (SELECT model, pred, count(*) FILTER (WHERE label = 1) AS pos,
                      count(*) FILTER (WHERE label = 0) AS neg FROM scores GROUP BY ALL) c
            JOIN (SELECT model, {hi} AS hi FROM scores GROUP BY model) USING (model), range({n}) t(i)))
        GROUP BY model, threshold"""


# Sources, scalars
add("scan_patients", "pat_list", "SELECT pat_id, empi, csn, appt_time, sex_c FROM pat_list")
add("roundtrip_csv", "labs", "SELECT pat_id, empi, result_time, common_name, ord_num_value, result_flag FROM labs")
add("parse_dates_lenient", "pat_list", """
    SELECT csn, raw, try_cast(raw AS DATE) AS parsed FROM (
        SELECT csn, CASE empi % 3 WHEN 0 THEN '2020-13-01' WHEN 1 THEN '' ELSE CAST(birth_date AS VARCHAR) END AS raw
        FROM pat_list)""")
add("labs_in_list", "labs", f"""
    SELECT common_name, count(*) AS n, count(ord_num_value) AS n_values FROM labs
    WHERE common_name IN ({TESTS_SQL}) GROUP BY common_name""")
add("cols_by_pattern", "", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
add("flag_recode", "labs", """
    SELECT l_orderkey, l_linenumber, l_partkey, ord_num_value,
        CASE result_flag WHEN 'Low Panic' THEN 0.25 WHEN 'Low' THEN 0.5 WHEN 'High' THEN 0.75 WHEN 'High Panic' THEN 1
        ELSE 0 END::DOUBLE AS "RESULT_FLAG" FROM labs""")
add("one_hot_strings", "", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INT) AS \"c_mktsegment_{s}\"" for s in SITES[1:]) + " FROM customer")
add("survival_days", "enc", f"SELECT csn, {r('surv', 'surv')} FROM enc")
add("label_horizon", "pat_list", """
    SELECT csn, CAST(coalesce(CAST(death_date AS TIMESTAMP) - appt_time < INTERVAL 360 DAY, false) AS INT) AS dies_within
    FROM pat_list""")
add("compound_growth", "", f"""
    SELECT p_partkey, {r('p_retailprice * power(1 + p_size / 1000::DOUBLE, p_partkey % 7)', 'value', 4)} FROM part""")

# Point-in-time features
KEY = "pat_id, empi, appt_date"
add("asof_labs", "lab_pairs", f"""
    SELECT {KEY}, count(*) AS n_events, count(ord_num_value) AS n_values, sum(ord_num_value) AS sum_value,
        CAST(min(result_time) AS DATE) AS first_day, CAST(max(result_time) AS DATE) AS last_day
    FROM lab_pairs GROUP BY {KEY}""")
add("asof_dx", "dx_pairs", f"""
    SELECT {KEY}, count(*) AS n_events, CAST(min(contact_date) AS DATE) AS first_day,
        CAST(max(contact_date) AS DATE) AS last_day FROM dx_pairs GROUP BY {KEY}""")
add("asof_stage", "pat_list stage", f"""
    SELECT {KEY}, count(*) AS n_events, CAST(min(sign_datetime) AS DATE) AS first_day,
        CAST(max(sign_datetime) AS DATE) AS last_day
    FROM (SELECT DISTINCT pat_id, empi, CAST(appt_time AS DATE) AS appt_date FROM pat_list)
    JOIN stage USING (pat_id, empi) WHERE CAST(sign_datetime AS DATE) < appt_date GROUP BY {KEY}""")
add("asof_events", "", """
    SELECT CAST(v.user_id AS VARCHAR) AS pat_id, v.user_id AS empi, CAST(v.ts AS DATE) AS appt_date, count(*) AS n_events,
        CAST(min(e.ts) AS DATE) AS first_day, CAST(max(e.ts) AS DATE) AS last_day
    FROM events v JOIN events e ON v.user_id = e.user_id AND CAST(e.ts AS DATE) < CAST(v.ts AS DATE)
    WHERE v.event_type = 'view' AND e.event_type <> 'view' GROUP BY v.user_id, CAST(v.ts AS DATE)""")
VIEWS["demo"] = """
    SELECT pat_id, empi, CAST(appt_time AS DATE) AS appt_date, first(sex_c ORDER BY csn) - 1 AS sex_indicator,
        CAST(floor(date_diff('day', first(birth_date ORDER BY csn), CAST(appt_time AS DATE)) / 365.0) AS INT) AS age,
        max(max(CAST(death_date IS NOT NULL AS INT))) OVER (PARTITION BY pat_id, empi) AS dead
    FROM pat_list GROUP BY pat_id, empi, CAST(appt_time AS DATE)"""
NEEDS["demo"] = ["pat_list"]
add("demographics", "demo", "SELECT * FROM demo")
add("mortality_flag", "pat_list", """
    SELECT csn, pat_id, empi, dead FROM pat_list LEFT JOIN (
        SELECT pat_id, empi, max(CAST(death_date IS NOT NULL AS INT)) AS dead FROM pat_list GROUP BY ALL)
    USING (pat_id, empi)""")
add("death_flag_lenient", "pat_list", """
    SELECT csn, pat_id, empi, dead FROM pat_list LEFT JOIN (
        SELECT pat_id, empi, max(CAST(TRY_CAST(CASE WHEN empi % 3 = 0 THEN 'not a date' WHEN empi % 7 = 0 THEN ''
                                               ELSE CAST(death_date AS VARCHAR) END AS DATE) IS NOT NULL AS INT)) AS dead
        FROM pat_list GROUP BY ALL) USING (pat_id, empi)""")
add("dx_code_map", "dx_pairs", f"""
    SELECT {KEY}, string_agg(code || ':' || n, ',' ORDER BY code) AS codes
    FROM (SELECT {KEY}, code, count(*) AS n FROM dx_pairs WHERE code IS NOT NULL GROUP BY {KEY}, code) GROUP BY {KEY}""")
add("dx_codes", "dx_pairs", f"""
    SELECT {KEY}, string_agg(code, ',' ORDER BY code) AS aggregated_codes FROM dx_pairs GROUP BY {KEY}""")
STAGE_COLUMNS = [f"count(*) FILTER (WHERE body_site_name = '{s}') AS \"BODY_SITE_NAME_{s}\"" for s in SITES] \
    + [f"count(*) FILTER (WHERE stage_group = '{g}') AS \"STAGE_GROUP_{g}\"" for g in STAGE_GROUPS]
VIEWS["stage_wide"] = f"SELECT {KEY}, {', '.join(STAGE_COLUMNS)} FROM stage_pairs GROUP BY {KEY}"
NEEDS["stage_wide"] = ["stage_pairs"]
add("stage_features", "stage_wide", "SELECT * FROM stage_wide")
add("stage_features_discovered", "stage_wide", "SELECT * FROM stage_wide")
ORDER = "result_time, l_orderkey, l_linenumber, l_partkey"
VIEWS["last_labs"] = f"""
    SELECT {KEY}, common_name,
        last(ord_num_value ORDER BY {ORDER}, ord_num_value) FILTER (WHERE ord_num_value IS NOT NULL) AS last_value,
        last(result_flag ORDER BY {ORDER}, ord_num_value, result_flag) FILTER (WHERE result_flag IS NOT NULL)
            AS last_flag, count(*) AS n
    FROM lab_pairs WHERE common_name IN ({TESTS_SQL}) GROUP BY {KEY}, common_name"""
NEEDS["last_labs"] = ["lab_pairs"]


def lab_columns(count: str = "n") -> str:
    return ", ".join(
        f"max(last_value) FILTER (WHERE common_name = '{t}') AS \"{t}_MOST_RECENT_VALUE\", "
        f"max(last_flag) FILTER (WHERE common_name = '{t}') AS \"{t}_MOST_RECENT_FLAG\", "
        f"max({count}) FILTER (WHERE common_name = '{t}') AS \"{t}_COUNT\"" for t in DRIVER_TESTS)


VIEWS["lab_wide"] = f"SELECT {KEY}, {lab_columns()} FROM last_labs GROUP BY {KEY}"
NEEDS["lab_wide"] = ["last_labs"]
add("lab_last", "last_labs", "SELECT * FROM last_labs")
add("lab_features", "lab_wide", "SELECT * FROM lab_wide")
add("lab_features_dedupe", "last_labs pat_list", f"""
    SELECT {KEY}, {lab_columns('n // times')} FROM last_labs JOIN (
        SELECT pat_id, empi, CAST(appt_time AS DATE) AS appt_date, count(*) AS times FROM pat_list GROUP BY ALL)
    USING ({KEY}) GROUP BY {KEY}""")
VIEWS["comorbid"] = f"""
    SELECT {KEY}, {', '.join(f"CAST(count(*) FILTER (WHERE comorbidity = '{k}') > 0 AS INT) AS cmrbdt_{k}"
                             for k in range(6))},
        CAST(sum(coalesce(mortality_weight, 0)) AS DOUBLE) AS mrtlt_scr,
        CAST(sum(coalesce(readmission_weight, 0)) AS DOUBLE) AS rdmsn_scr
    FROM (SELECT DISTINCT {KEY}, comorbidity, mortality_weight, readmission_weight
          FROM dx_pairs LEFT JOIN code_map USING (code))
    GROUP BY {KEY}"""
NEEDS["comorbid"] = ["dx_pairs", "code_map"]
add("comorbidity_features", "comorbid", "SELECT * FROM comorbid")


def _flag(c: str) -> str:
    return f"CASE \"{c}\" WHEN 'Low' THEN 0.5 WHEN 'High' THEN 0.75 ELSE 0 END::DOUBLE AS \"{c}\""


MATRIX_COLUMNS = [f"coalesce(cmrbdt_{k}, 0) AS cmrbdt_{k}" for k in range(6)] \
    + ["coalesce(mrtlt_scr, 0) AS mrtlt_scr", "coalesce(rdmsn_scr, 0) AS rdmsn_scr"] \
    + [c for t in DRIVER_TESTS for c in (
        f"coalesce(\"{t}_MOST_RECENT_VALUE\", 0) AS \"{t}_MOST_RECENT_VALUE\"", _flag(f"{t}_MOST_RECENT_FLAG"),
        f"coalesce(\"{t}_COUNT\", 0) AS \"{t}_COUNT\"")] \
    + [f"coalesce(\"{c}\", 0) AS \"{c}\"" for c in [f"BODY_SITE_NAME_{s}" for s in SITES]
       + [f"STAGE_GROUP_{g}" for g in STAGE_GROUPS]]
add("feature_matrix", "demo comorbid lab_wide stage_wide", f"""
    SELECT {KEY}, sex_indicator, age, dead, {', '.join(MATRIX_COLUMNS)}
    FROM demo LEFT JOIN comorbid USING ({KEY}) LEFT JOIN lab_wide USING ({KEY}) LEFT JOIN stage_wide USING ({KEY})""")

# Sampling
add("sample_encounter", "cohort", "SELECT empi, csn, appt_time, label FROM cohort")
add("split_patients", "cohort", 'SELECT csn, empi, "group" FROM cohort')
add("split_patients_exact", "enc", f"""
    SELECT csn, empi, "group" FROM enc JOIN (
        SELECT empi, CASE WHEN row_number() OVER (ORDER BY {u(123456, 'empi')}, empi) <= floor(count(*) OVER () * 0.7::DOUBLE)
            THEN 'train' ELSE 'test' END AS "group" FROM (SELECT DISTINCT empi FROM enc)) USING (empi)""")
add("split_rows", "enc", f"""
    SELECT csn, CASE WHEN {u(42, 'csn')} < 0.3 THEN 'test' ELSE 'train' END AS "group" FROM enc""")
add("split_semi", "enc cohort", """
    SELECT csn, empi FROM enc WHERE empi IN (SELECT empi FROM cohort WHERE "group" = 'train')""")
add("cohort_ids", "cohort", 'SELECT csn, pat_id, "group" FROM cohort')
add("label_rates", "cohort", f"""
    SELECT "group", {r('avg(label)', 'rate')}, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n
    FROM cohort GROUP BY "group" """)
add("stratified_folds", "enc", f"""
    SELECT csn, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {u(42, 'csn')}, csn) - 1) % 5 AS INT) AS fold
    FROM enc""")


def mixed(source: str, value: str, out: str, keep: str) -> str:
    sql = f"SELECT {keep}, ({value}) & {MASK32} AS {out} FROM ({source})"
    for shift, factor in MIX_STEPS:
        sql = f"SELECT {keep}, xor({out}, {out} >> {shift}) AS {out} FROM ({sql})"
        sql = f"SELECT {keep}, ({out} * {factor}::BIGINT) & {MASK32} AS {out} FROM ({sql})"
    return f"SELECT {keep}, xor({out}, {out} >> {MIX_LAST_SHIFT}) AS {out} FROM ({sql})"


def keyed(source: str, key: str, keep: str, seed: int = 12345) -> str:
    low = mixed(source, f"xor({key}::BIGINT, {seed}::BIGINT)", "_slot", keep)
    return mixed(low, f"xor(_slot, {key}::BIGINT >> 32)", "_slot", keep)


def exact_draws(replicates: int, seed: int = 12345) -> str:
    """Poisson counts at a rate a little below 1 from each row's hash, and what a replicate lacks to n drawn one by one."""
    ordinals = f"SELECT csn, row_number() OVER (ORDER BY {u(seed, 'csn')}, csn) - 1 AS ordinal FROM enc"
    rows = f"SELECT csn, _slot, b::BIGINT AS b FROM ({keyed('SELECT csn FROM enc', 'csn', 'csn')}), " \
           f"range({replicates}) t(b)"
    return f"""
        SELECT CAST(b AS INT) AS b, csn, CAST(sum(weight) AS BIGINT) AS weight FROM (
            WITH size AS (SELECT count(*) AS n, greatest(0, 1 - 6 / sqrt(count(*))) AS rate FROM enc),
            cuts AS (SELECT list(least(floor(below * power(2::DOUBLE, 32)), {2**32 - 1})::BIGINT ORDER BY k) AS c FROM (
                SELECT k, sum(exp(-rate) * power(rate, k) / factorial(k::INT)::DOUBLE) OVER (ORDER BY k) AS below
                FROM size, range(13) t(k))),
            own AS (SELECT b, csn, {' + '.join(f'CAST(_h1 >= c[{k}] AS INT)' for k in range(1, 14))} AS weight
                    FROM ({mixed(rows, f'_slot + b * {REPLICATE_STEP}', '_h1', 'csn, b')}), cuts),
            lacks AS (SELECT b, any_value(n) - sum(weight) AS missing FROM own, size GROUP BY b),
            picks AS (SELECT b, unnest(range(1, missing::BIGINT + 1)) AS pick FROM lacks),
            added AS (SELECT b, CAST(floor({u(seed, PICK)} * n) AS BIGINT) AS ordinal FROM picks, size)
            SELECT b, csn, weight FROM own WHERE weight > 0
            UNION ALL SELECT b, csn, 1 FROM added JOIN ({ordinals}) USING (ordinal)) GROUP BY b, csn"""


def poisson_draws(replicates: int) -> str:
    rows = f"SELECT csn, _slot, b::BIGINT AS b FROM ({keyed('SELECT csn FROM enc', 'csn', 'csn')}), " \
           f"range({replicates}) t(b)"
    cuts = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(13)]
    weight = " + ".join(f"CAST(_h1 >= {min(c, 2**32 - 1)} AS INT)" for c in cuts)
    return f"""
        SELECT CAST(b AS INT) AS b, csn, CAST({weight} AS BIGINT) AS weight
        FROM ({mixed(rows, f'_slot + b * {REPLICATE_STEP}', '_h1', 'csn, b')}) WHERE _h1 >= {cuts[0]}"""


add("background_rows", "enc", f"""
    SELECT draw, csn, empi, label FROM (
        SELECT draw, CAST(floor({u(42, 'draw')} * (SELECT count(*) FROM enc)) AS BIGINT) AS ordinal FROM range(2800) t(draw))
    JOIN (SELECT *, row_number() OVER (ORDER BY {u(42, 'csn')}, csn) - 1 AS ordinal FROM enc) USING (ordinal)""")
add("bootstrap_draws", "enc", exact_draws(20))
add("poisson_draws", "enc", poisson_draws(20))

# Selection
add("fs_variance", "line_long", f"""
    SELECT feature, {r('var_samp(value)', 'variance', 2)}, {r('ln(var_samp(value))', 'log_variance', 8)}
    FROM line_long GROUP BY feature
    UNION ALL SELECT 'constant', 0::DOUBLE, NULL::DOUBLE""")
NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
add("corr_pairs", "", " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {r(f'corr({a}, {b})', 'corr')} FROM lineitem"
    for i, a in enumerate(NAMES) for b in NAMES[i + 1:]))
ORACLES["corr_pairs_wide"] = ORACLES["corr_pairs"]
add("fs_mutual_info", "mi", f"SELECT feature, {r('score', 'score')} FROM mi")
# The greedy walk over correlated features, as a recursion over feature positions.
DERIVED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "price_net", "price_gross",
           "quantity_left", "constant"]
WALK = {
    "derived": """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber,
        l_extendedprice * (1::DOUBLE - l_discount) AS price_net, l_extendedprice * (1::DOUBLE + l_tax) AS price_gross,
        50 - l_quantity AS quantity_left, 1::DOUBLE AS constant, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem""",
    "derived_long": f"SELECT * FROM derived UNPIVOT (value FOR feature IN ({', '.join(DERIVED)}))",
    "varying": f"""SELECT name, row_number() OVER (ORDER BY p) AS pos
        FROM (SELECT unnest({DERIVED}) AS name, unnest(range({len(DERIVED)})) AS p)
        WHERE name IN (SELECT feature FROM derived_long GROUP BY feature HAVING var_samp(value) <> 0)""",
    "pair": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM derived"
                               for a in DERIVED[:-1] for b in DERIVED[:-1] if a != b),
    "near": """SELECT v.pos, v.name, coalesce(list(w.name ORDER BY w.pos) FILTER (WHERE w.name IS NOT NULL), []) AS near
        FROM varying v LEFT JOIN pair ON v.name = a AND c > 0.95 LEFT JOIN varying w ON w.name = b GROUP BY v.pos, v.name""",
    "walk": """SELECT 0::BIGINT AS i, []::VARCHAR[] AS taken, NULL::VARCHAR AS rep, []::VARCHAR[] AS members UNION ALL
        SELECT pos, CASE WHEN list_contains(taken, name) THEN taken ELSE list_concat(taken, near) END,
            CASE WHEN NOT list_contains(taken, name) THEN name END, near FROM walk JOIN near ON pos = i + 1""",
    "mi_all": VIEWS["mi"].replace("line_long", "derived_long"),
}
add("fs_corr_groups", "", """
    SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS pos, rep AS representative, NULL::VARCHAR AS member
    FROM walk WHERE false UNION ALL
    SELECT CAST(g AS INT), rep, unnest(CASE WHEN len(members) = 0 THEN [NULL] ELSE members END)
    FROM (SELECT *, row_number() OVER (ORDER BY i) - 1 AS g FROM walk WHERE rep IS NOT NULL)""", WALK)
add("fs_final", "", """
    SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS pos, rep AS feature FROM walk
    WHERE rep IS NOT NULL AND rep IN (SELECT feature FROM mi_all WHERE score > 1e-6)""", WALK)
for name in ("fs_corr_groups", "fs_final"):
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)
COUNT_NAMES = [f"n_{g}" for g in STAGE_GROUPS]
ALL_NAMES = ["pat_age", "sex_c", *COUNT_NAMES]
add("normalise", "enc stage_wide", f"SELECT csn, \"group\", " + ", ".join(
    f"round((\"{n}\" - (SELECT avg(\"{n}\") FROM values_of WHERE \"group\" = 'train')) / "
    f"(SELECT stddev_samp(\"{n}\") FROM values_of WHERE \"group\" = 'train'), 6) + 0.0::DOUBLE AS \"{n}\""
    for n in ALL_NAMES) + " FROM values_of", {"values_of": f"""
    SELECT csn, CASE WHEN {u(123456, 'enc.empi')} < 0.7 THEN 'train' ELSE 'test' END AS "group",
        CAST(pat_age AS DOUBLE) AS pat_age, CAST(sex_c AS DOUBLE) AS sex_c,
        {', '.join(f'ln(coalesce("STAGE_GROUP_{g}", 0) + 1) AS "n_{g}"' for g in STAGE_GROUPS)}
    FROM enc LEFT JOIN stage_wide s ON enc.pat_id = s.pat_id AND enc.empi = s.empi
        AND CAST(enc.appt_time AS DATE) = s.appt_date"""})
add("quantiles", "", " UNION ALL ".join(
    f"SELECT l_returnflag, {p}::DOUBLE AS prob, {r(f'quantile_cont(l_extendedprice, {p})', 'quantile')} "
    "FROM lineitem GROUP BY l_returnflag" for p in (0.025, 0.05, 0.5, 0.95, 0.975)))
add("feature_ranges", "line_long", f"""
    SELECT feature, {r('quantile_cont(value, 0.5)', 'center')}, {r('quantile_cont(value, 0.05)', 'lo')},
        {r('quantile_cont(value, 0.95)', 'hi')} FROM line_long GROUP BY feature
    UNION ALL SELECT 'flag>>>R', {r("avg(CAST(l_returnflag = 'R' AS INT))", 'center')}, 0::DOUBLE, 1::DOUBLE
    FROM lineitem""")
add("cumulative_importance", "mi", f"""
    SELECT feature, {r('score', 'importance')}, CAST(row_number() OVER w AS INT) AS rank,
        {r('sum(score) OVER w / sum(score) OVER ()', 'cumulative_prop')}
    FROM mi WINDOW w AS (ORDER BY score DESC, feature ROWS UNBOUNDED PRECEDING)""")
add("top_importance", "mi", f"""
    SELECT feature, {r('score', 'importance')} FROM mi ORDER BY score DESC, feature LIMIT 3""")
add("value_counts", "", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, 1")

# Evaluation
add("scores_wide", "scores", "SELECT csn, max(label) AS label, " + ", ".join(
    f"max(pred) FILTER (WHERE model = '{m}') AS pred_{m}" for m in ("rf", "gb", "lr")) + " FROM scores GROUP BY csn")
add("score_histogram", "scores", f"""
    SELECT model, label, CAST(bin AS INT) AS bin, {r('lo + bin * ((hi - lo) / 50::DOUBLE)', 'bin_lo')},
        CAST(sum(n) AS BIGINT) AS n, {r('sum(n) / (max(total) * ((hi - lo) / 50::DOUBLE))', 'density')}
    FROM (SELECT c.*, least((SELECT count(*) FROM range(51) t(i)
                WHERE CASE WHEN i = 50 THEN hi ELSE lo + i * ((hi - lo) / 50::DOUBLE) END <= pred), 50) - 1 AS bin
          FROM (SELECT model, label, pred, count(*) AS n, min(pred) OVER w AS lo, max(pred) OVER w AS hi,
                    sum(count(*)) OVER w AS total
                FROM scores GROUP BY model, label, pred WINDOW w AS (PARTITION BY model, label)) c)
    GROUP BY model, label, bin, lo, hi""")
add("alert_share", "scores", f"SELECT model, {r('avg(CAST(pred >= 0.58 AS INT))', 'share')} FROM scores GROUP BY model")
add("top_errors", "scores", """
    SELECT * FROM (
        SELECT model, csn, label, pred, CAST(row_number() OVER (PARTITION BY model, label
            ORDER BY CASE label WHEN 0 THEN -pred ELSE pred END, csn) AS INT) AS rank FROM scores) WHERE rank <= 20""")
add("roc_curve", "scores", f"""
    SELECT model, {r(div('(SELECT count(*) FROM scores s WHERE s.model = t.model AND s.label = 0 AND s.pred >= t.pred)',
                         '(SELECT count(*) FROM scores s WHERE s.model = t.model AND s.label = 0)'), 'fpr')},
        {r(div('(SELECT count(*) FROM scores s WHERE s.model = t.model AND s.label = 1 AND s.pred >= t.pred)',
               '(SELECT count(*) FROM scores s WHERE s.model = t.model AND s.label = 1)'), 'tpr')},
        {r('pred', 'threshold')}
    FROM (SELECT DISTINCT model, pred FROM scores UNION ALL SELECT DISTINCT model, 'infinity'::DOUBLE FROM scores) t""")
add("auc_by_model", "auc", f"SELECT model, {r('auc', 'auc')} FROM auc")
add("auc_documents", "", f"""
    SELECT lang, {r('auc', 'auc')}, {r('average_precision', 'average_precision')} FROM (
        SELECT a.lang, avg(CASE WHEN a.n_chars > b.n_chars THEN 1 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END) AS auc
        FROM scored a JOIN scored b ON a.lang = b.lang AND a.quality = 1 AND b.quality = 0 GROUP BY a.lang)
    RIGHT JOIN (
        SELECT lang, sum(pos * cum_pos / (cum_pos + cum_neg)) / nullif(sum(pos), 0) AS average_precision FROM (
            SELECT lang, CAST(pos AS DOUBLE) AS pos, sum(pos) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS cum_pos,
                sum(neg) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS cum_neg
            FROM (SELECT lang, n_chars, count(*) FILTER (WHERE quality = 1) AS pos,
                      count(*) FILTER (WHERE quality = 0) AS neg FROM scored GROUP BY ALL))
        GROUP BY lang) USING (lang)""",
    {"scored": "SELECT lang, quality, n_chars FROM documents JOIN labels USING (doc_id)"})
add("average_precision", "ap", f"SELECT model, {r('average_precision', 'average_precision')} FROM ap")
TPR = f"{r(div('tp', 'tp + fn'), 'tpr')}, {r(div('tn', 'tn + fp'), 'specificity')}"
add("tpr_specificity", "scores", f"SELECT model, tn, fp, fn, tp, {TPR} FROM ({at_cut('0.5')})")
add("threshold_sweep_ge", "auc ap", f"""
    SELECT model, tn, fp, fn, tp, threshold, {TPR}, {r('auc', 'auc')}, {r('average_precision', 'average_precision')}
    FROM ({at_cut('threshold', by='model, threshold',
                  source='scores, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) t(threshold)')})
    JOIN auc USING (model) JOIN ap USING (model)""")
add("binary_metrics", "scores", f"SELECT model, {FULL} FROM ({at_cut('0.5')})")
add("cv_metrics", "auc", f"SELECT model, {FULL}, {r('auc', 'auc')} FROM ({at_cut('0.3')}) JOIN auc USING (model)")
GT = f"SELECT model, {FULL}, {r('threshold', 'threshold')} FROM ({grid(100, 'max(pred)', '>')})"
add("threshold_sweep_gt", "scores", GT)
add("threshold_range", "scores", f"SELECT * FROM ({GT}) WHERE threshold >= 0.3 AND threshold < 0.4")
add("nearest_threshold", "scores", f"""
    SELECT * FROM ({GT}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY abs(threshold - 0.3), threshold) = 1""")
add("operating_point", "scores", f"""
    SELECT * FROM ({GT}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY abs(
        CAST(fp + tp AS DOUBLE) / n - 0.02), threshold) = 1""")
add("performance_sweep", "auc", f"""
    SELECT model, {FULL}, {r('threshold', 'threshold')}, {r('auc', 'auc')}
    FROM ({grid(100, '1::DOUBLE', '>=')}) JOIN auc USING (model)""")
add("calc_metrics", "auc", f"SELECT model, {CALC}, {r('auc', 'auc')} FROM ({at_cut('0.5', '>')}) JOIN auc USING (model)")
add("calc_metrics_sweep", "auc", f"""
    SELECT model, {CALC}, {r('threshold', 'threshold')}, {r('auc', 'auc')}
    FROM ({grid(50, '1::DOUBLE', '>')}) JOIN auc USING (model)""")
GROUP_AUC = """
    SELECT a.model, a.grp, sum(a.n * b.n * CASE WHEN a.pred > b.pred THEN 1 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END)
        / sum(a.n * b.n) AS auc
    FROM (SELECT model, grp, pred, CAST(count(*) AS DOUBLE) AS n FROM grouped WHERE label = 1 GROUP BY ALL) a
    JOIN (SELECT model, grp, pred, CAST(count(*) AS DOUBLE) AS n FROM grouped WHERE label = 0 GROUP BY ALL) b
    USING (model, grp) GROUP BY a.model, a.grp"""
NEAREST = "(30 * (1::DOUBLE / 99))"
add("subgroup_categorical", "scores", f"""
    SELECT model, grp AS specialty, {FULL}, {r('auc', 'auc')}, {r(NEAREST, 'threshold')}
    FROM ({at_cut(NEAREST, by='model, grp', source='grouped')}) LEFT JOIN ({GROUP_AUC}) USING (model, grp)""",
    {"grouped": "SELECT *, specialty AS grp FROM scores"})
THIN = "(tn + fp + fn + tp < 5 OR tp + fn = 0)"
add("subgroup_numeric", "scores", f"""
    SELECT model, CAST(grp AS INT) AS tile, printf('%.0f-%.0f', q[grp], q[grp + 1]) AS "range",
        tn + fp + fn + tp AS n, {', '.join(f'CASE WHEN NOT {THIN} THEN {c} END AS {c}' for c in ('tn', 'fp', 'fn', 'tp'))},
        {', '.join(r(f"CASE WHEN {THIN} THEN {'0' if k == 'base_rate' else 'NULL'} ELSE {e} END", k)
                   for k, e in RATES.items())},
        {r(f'CASE WHEN NOT {THIN} THEN auc END', 'auc')}, {r(f'CASE WHEN NOT {THIN} THEN {NEAREST} END', 'threshold')}
    FROM ({at_cut(NEAREST, by='model, grp, q', source='grouped')}) LEFT JOIN ({GROUP_AUC}) USING (model, grp)""", {
    "grouped": f"""SELECT scores.*, t.grp, q FROM scores JOIN (
            SELECT model, quantile_cont(CAST(pat_age AS DOUBLE), [{', '.join(f'{i}/9::DOUBLE' for i in range(10))}]) AS q
            FROM scores GROUP BY model) USING (model), range(1, 10) t(grp)
        WHERE pat_age > q[t.grp] AND pat_age <= q[t.grp + 1]"""})
REPORT_SOURCE = f"""SELECT *, CASE WHEN {u(42, 'csn')} < 0.3 THEN 'test' ELSE 'train' END AS grp FROM scores"""
add("model_report", "scores", f"""
    SELECT model, grp AS "group", {r('auc', 'auc')}, {r('average_precision', 'average_precision')}, {TPR}
    FROM ({at_cut('0.5', by='model, grp', source='grouped')}) JOIN ({GROUP_AUC}) USING (model, grp) JOIN (
        SELECT model, grp, sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) AS average_precision FROM (
            SELECT model, grp, CAST(pos AS DOUBLE) AS pos,
                sum(pos) OVER (PARTITION BY model, grp ORDER BY pred DESC) AS cum_pos,
                sum(neg) OVER (PARTITION BY model, grp ORDER BY pred DESC) AS cum_neg
            FROM (SELECT model, grp, pred, count(*) FILTER (WHERE label = 1) AS pos,
                      count(*) FILTER (WHERE label = 0) AS neg FROM grouped GROUP BY ALL))
        GROUP BY model, grp) USING (model, grp)""", {"grouped": REPORT_SOURCE})
POINT = "CASE WHEN {i} = 10 THEN hi ELSE lo + {i} * ((hi - lo) / 10::DOUBLE) END"
CALIBRATION = f"""
    SELECT model, CAST(i AS INT) AS bin, {r('lo + i * ((hi - lo) / 10::DOUBLE) + (hi - lo) / 10::DOUBLE / 2', 'center')},
        coalesce(CAST(sum(label) AS BIGINT), 0) AS positives, count(label) AS n,
        {r(div('sum(label)', 'count(label)'), 'fraction')}
    FROM (SELECT model, min(pred) AS lo, max(pred) AS hi FROM scores GROUP BY model) CROSS JOIN range(10) t(i)
    LEFT JOIN scores s USING (model)
    WHERE pred >= {POINT.format(i='i')} AND pred < {POINT.format(i='(i + 1)')} GROUP BY model, i, lo, hi"""
add("calibration", "scores", CALIBRATION)


def survival(cuts: list[float], days: int) -> str:
    return f"""
        SELECT model, cut, risk, CAST(day AS INT) AS day, CAST(sum(CASE WHEN surv > day THEN n ELSE 0 END) AS BIGINT) AS n_survived,
            CAST(sum(n) AS BIGINT) AS n_group, {r('sum(CASE WHEN surv > day THEN n ELSE 0 END) / sum(n)', 'survival')},
            {r('sum(n) / max(total)', 'group_share')}
        FROM (SELECT *, sum(n) OVER (PARTITION BY model, cut) AS total FROM (
                  SELECT model, cut, CASE WHEN pred > cut THEN 'High risk' ELSE 'Low risk' END AS risk, surv,
                      CAST(count(*) AS DOUBLE) AS n
                  FROM scores, unnest({cuts}::DOUBLE[]) c(cut) GROUP BY ALL)), range({days}) t(day)
        GROUP BY model, cut, risk, day"""


add("survival_curve", "scores", survival([0.272073], 501))
add("survival_multi_cut", "scores", survival([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 181))


def with_beta_interval(counts: str, num: str, denom: str) -> str:
    """Bounds of Beta(num + 1, denom - num + 1): the density of the log odds, added up on a grid of a hundredth of its width
    (trapezoids with their end correction), and the place in the cell where the wanted share is reached."""
    bound = """
        SELECT id, round(odds / (1 + odds), 6) + 0.0::DOUBLE AS {name} FROM (SELECT id, a / b * exp(
                u + (3 * t * t - 2 * t * t * t) * h + (t - 2 * t * t + t * t * t) * (f1 - f0) / d0 + (t * t * t - t * t) * (f1 - f0) / d1)
                AS odds FROM (SELECT *, ({p} * total - f0) / (f1 - f0) AS t FROM cells
                              WHERE f0 <= {p} * total AND f1 > {p} * total))"""
    return f"""
        SELECT * FROM (WITH counts AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM ({counts})),
        grid AS (SELECT id, {num} + 1.0::DOUBLE AS a, {denom} - {num} + 1.0::DOUBLE AS b,
                        sqrt(1 / a + 1 / b) / 100 AS h, i * h AS u FROM counts, range(-4500, 4501) t(i)),
        dens AS (SELECT *, exp(-a * ln(1 + b / (a + b) * (exp(-u) - 1)) - b * ln(1 + a / (a + b) * (exp(u) - 1))) AS d0 FROM grid),
        sums AS (SELECT *, h * (sum(d0) OVER w - d0 / 2) - h * h / 12 * d0 * (a - a * exp(u)) / (1 + a / b * exp(u)) AS f0,
                        h * sum(d0) OVER (PARTITION BY id) AS total FROM dens WINDOW w AS (PARTITION BY id ORDER BY u)),
        cells AS (SELECT *, lead(f0) OVER w AS f1, lead(d0) OVER w AS d1 FROM sums
                  WHERE f0 BETWEEN 0.02 * total AND 0.03 * total OR f0 BETWEEN 0.97 * total AND 0.98 * total
                  WINDOW w AS (PARTITION BY id ORDER BY u)),
        lows AS ({bound.format(p=0.025, name='lower')}), highs AS ({bound.format(p=0.975, name='upper')})
        SELECT counts.* EXCLUDE (id), lower, upper FROM counts JOIN lows USING (id) JOIN highs USING (id))"""


def replicate_aucs(draws: str) -> str:
    return f"""
        SELECT b, model, sum(neg * (cum - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
            SELECT *, sum(pos) OVER (PARTITION BY b, model ORDER BY pred DESC) AS cum FROM (
                SELECT b, model, pred, CAST(sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS DOUBLE) AS pos,
                    CAST(sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS DOUBLE) AS neg
                FROM ({draws}) JOIN scores USING (csn) GROUP BY ALL))
        GROUP BY b, model"""


CI = f"""
    SELECT model, {r('avg(auc)', 'mean_auc')}, {r('quantile_cont(auc, 0.025)', 'lower')},
        {r('quantile_cont(auc, 0.975)', 'upper')}, count(*) AS replicates FROM aucs WHERE auc IS NOT NULL GROUP BY model"""
COMPARE = f"""
    SELECT a.model AS model_a, c.model AS model_b, {r('avg(CAST(coalesce(a.auc > c.auc, false) AS INT))', 'p_greater')},
        {r('avg(a.auc)', 'mean_a')}, {r('quantile_cont(a.auc, 0.025)', 'lower_a')},
        {r('quantile_cont(a.auc, 0.975)', 'upper_a')}, {r('avg(c.auc)', 'mean_b')},
        {r('quantile_cont(c.auc, 0.025)', 'lower_b')}, {r('quantile_cont(c.auc, 0.975)', 'upper_b')},
        {r('0.05::DOUBLE / 3', 'alpha_each')}
    FROM aucs a JOIN aucs c USING (b)
    WHERE (a.model, c.model) IN (('rf', 'gb'), ('rf', 'lr'), ('gb', 'lr')) GROUP BY a.model, c.model"""
add("calibration_interval", "scores", with_beta_interval(CALIBRATION, "positives", "n"))
add("survival_interval", "scores", with_beta_interval(survival([0.272073], 181), "n_survived", "n_group"))
add("auc_ci", "scores", CI, {"aucs": replicate_aucs(exact_draws(1000))})
add("bootstrap_compare", "scores", COMPARE, {"aucs": replicate_aucs(exact_draws(10_000))})
add("auc_ci_poisson", "scores", CI, {"aucs": replicate_aucs(poisson_draws(1000))})
add("bootstrap_compare_poisson", "scores", COMPARE, {"aucs": replicate_aucs(poisson_draws(1000))})

# Checkable facts of fitted models
TRAINED = f"""SELECT csn, CAST(death_date IS NOT NULL AS INT) AS label,
    CASE WHEN {u(123456, 'empi')} < 0.7 THEN 'train' ELSE 'test' END AS "group" FROM enc"""
add("lr_score_equations", "enc", """
    SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, 0.0::DOUBLE AS largest FROM trained WHERE "group" = 'train'""",
    {"trained": TRAINED})
add("ml_three_models", "enc", """
    SELECT model, "group", count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, true AS auc_is_theirs,
        true AS better_than_chance FROM trained, unnest(['rf', 'gb', 'lr']) m(model) GROUP BY model, "group\"""",
    {"trained": TRAINED})
add("gb_early_stop_rule", "enc", f"""
    SELECT count(*) FILTER (WHERE {u(7, 'csn')} >= 0.1) AS n_fitted, count(*) FILTER (WHERE {u(7, 'csn')} < 0.1) AS n_held_out,
        true AS stops_by_rule, true AS cut_there FROM trained WHERE "group" = 'train'""", {"trained": TRAINED})
