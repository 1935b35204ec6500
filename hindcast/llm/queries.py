"""The operators of this package as named queries over the driver tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.llm import (byte_cnn, exact_dedup, fingerprints, jaccard_join, language_model, mixing, periodic_runs, pieces,
                          substring_dedup, suffix_dedup, url_filter, vector_codes, warc)
from hindcast.llm.common import table
from hindcast.session import shared_dir

WORD_SQL = r"[^\x20\x09-\x0D]+"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The rules by host and path, and the hosts whose pages make up the list of blocked urls.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block"))
LISTED_HOSTS = r"(^|\.)(ads-track|spam-farm)\."


def op1_exact_dedup(spark, sf):
    return exact_dedup.find_duplicates(table(spark, sf, "documents")).drop("row")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def op2_url_filter(spark, sf):
    pages = table(spark, sf, "pages")
    listed = pages.select("url").where(url_filter.host_of(pages.url).rlike(LISTED_HOSTS))
    return url_filter.filter_urls(pages, URL_RULES, listed).drop("possible_hit")


_CASES = sorted(URL_RULES, key=lambda r: -len(r[0]))
_FITS = {rule: "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
         for rule, _ in _CASES}
OP2_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url,
             translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
             regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS asked FROM u),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda x: x <> ''
             AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') AS kept FROM p),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '')
             || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url,
      CASE {' '.join(f"WHEN {_FITS[r]} THEN '{r}'" for r, _ in _CASES)} END AS rule,
      CASE {' '.join(f"WHEN {_FITS[r]} THEN '{v}'" for r, v in _CASES)} END AS said FROM k),
l AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_matches(host, '(^|\.)(ads-track|spam-farm)\.')
      AND canonical_url <> '')
SELECT page_id, host, path, rule, canonical_url, canonical_url IN (SELECT canonical_url FROM l) AS listed,
       coalesce(said, CASE WHEN canonical_url IN (SELECT canonical_url FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c"""


def op7_source_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).selectExpr("doc_id", "mix_size AS size", "mix_source_size AS source_size",
                                               "mix_target AS target", "mix_taken AS taken")


# Sources in the order in which they reach their limit: the share per weight is that of the first prefix after which the next
# one stays below its limit.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}'))::BIGINT AS size,
                  length(regexp_replace(coalesce(text, ''), '[^#$%&*|!<>{{}}\\[\\]\\\\~^=+_]', '', 'g')) AS odd,
                  length(coalesce(text, '')) AS n,
                  ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / power(2::DOUBLE, 52)
                      + power(2::DOUBLE, -53) AS u FROM documents),
k AS (SELECT *, exp(ln(u) / greatest(0.1::DOUBLE, 1 - 8::DOUBLE * odd / greatest(n, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight,
             2::DOUBLE * source_size AS top FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY top / weight, source) AS nth FROM w),
p AS (SELECT a.nth, a.top / a.weight AS stops, greatest(0, (SELECT 1.5::DOUBLE * sum(source_size) FROM s)
             - coalesce((SELECT sum(top) FROM o WHERE nth < a.nth), 0)) / (SELECT sum(weight) FROM o WHERE nth >= a.nth) AS per
      FROM o a),
f AS (SELECT min_by(nth, nth) AS nth, min_by(per, nth) AS per FROM p WHERE per <= stops),
t AS (SELECT source, source_size, CASE WHEN f.nth IS NULL OR o.nth < f.nth THEN top ELSE weight * per END AS target FROM o, f),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
g AS (SELECT source, key, sum(size) AS together FROM k GROUP BY source, key),
r AS (SELECT source, key, sum(together) OVER (PARTITION BY source ORDER BY key DESC) - together / 2 AS middle FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target, k.size * (epochs
           + (target - epochs * source_size > 0 AND middle <= target - epochs * source_size)::INT)::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source JOIN r ON k.source IS NOT DISTINCT FROM r.source AND k.key = r.key"""


def op3_language_model(spark, sf):
    return language_model.score_documents(table(spark, sf, "documents"))


def op4_fingerprints(spark, sf):
    return fingerprints.fingerprint_documents(table(spark, sf, "documents"))


def op5_jaccard_join(spark, sf):
    return jaccard_join.link_documents(table(spark, sf, "documents")).drop("row", "label")


def op6_warc(spark, sf):
    path = shared_dir(spark)
    warc.write_archives(table(spark, sf, "pages"), path, compression="gzip")
    return warc.read_archives(spark, path).where("gap IS NULL") \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM m"""


def op8_substring_dedup(spark, sf):
    return substring_dedup.remove_repeats(table(spark, sf, "documents"))


OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD_SQL}'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS start FROM t WHERE len(w) >= 20),
h AS (SELECT doc_id, start, array_to_string(list_slice(w, start, start + 19), ' ') AS win FROM s),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS nth FROM h),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(start, start + 19)) AS pos FROM r WHERE nth > 1),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
k AS (SELECT t.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE
             [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(gone, i)] END AS kept
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""

def op9_quality(spark, sf):
    return byte_cnn.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_sentencepiece(spark, sf):
    return pieces.encode_documents(table(spark, sf, "documents"))


def op11_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeated_bytes(table(spark, sf, "documents"))


# Texts as hexadecimal digits, two for each byte, cut in pieces first: a substring is found by counting from the front.
OP11_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, x, n, unnest(range(0, n - 99, 200)) AS a FROM t WHERE n >= 100),
p AS (SELECT doc_id, substr(x, 2 * a + 1, 598) AS y, a, least(200, n - 99 - a) AS m FROM c),
s AS (SELECT doc_id, y, a, unnest(range(m)) AS i FROM p),
h AS (SELECT doc_id, a + i AS start, row_number() OVER (PARTITION BY substr(y, 2 * i + 1, 200) ORDER BY doc_id, a + i) AS nth
      FROM s),
r AS (SELECT doc_id, start, start - coalesce(lag(start) OVER w, -1000) > 100 AS fresh FROM h WHERE nth > 1
      WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
i AS (SELECT doc_id, start, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM r),
g AS (SELECT doc_id, span, min(start) AS a, max(start) + 100 AS b FROM i GROUP BY doc_id, span),
l AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a)::BIGINT AS n_removed FROM g GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(len(starts), 0) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(
           [substr(x, 2 * z[1] + 1, 2 * (z[2] - z[1])) FOR z IN list_zip(list_prepend(0, ends), list_append(starts, n))], '')
           END)) AS kept_sha256
FROM t LEFT JOIN l ON t.doc_id = l.doc_id"""


def op12_vector_codes(spark, sf):
    coded, books = vector_codes.compress(table(spark, sf, "embeddings"))
    sha = F.lit(books.sha256() if books else None).cast("string")
    return vector_codes.with_label_errors(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", sha.alias("codebooks_sha256"))


def _op12_sql(parts: int = 16, rounds: int = 2) -> str:
    """Each round: the nearest entry of every part, then the floor of the mean of what each entry got."""
    assigned = """
a{0} AS (SELECT vec_id, label, part, v, min(struct_pack(d := d, entry := entry)) AS best
         FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT
               AS d FROM p JOIN b{0} AS b USING (part)) GROUP BY ALL)"""
    refined = """
m{0} AS (SELECT part, best.entry AS entry, pos, sum(v[pos])::BIGINT AS s, count(*) AS n
         FROM a{0}, (SELECT unnest(range(1, dim // 16 + 1)) AS pos FROM w) GROUP BY ALL),
b{1} AS (SELECT part, entry, coalesce(list((CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END) ORDER BY pos)
                                      FILTER (s IS NOT NULL), any_value(v)) AS v
         FROM b{0} LEFT JOIN m{0} USING (part, entry) GROUP BY part, entry)"""
    steps = [assigned.format(t) + "," + refined.format(t, t + 1) for t in range(rounds)] + [assigned.format(rounds)]
    return f"""
WITH k AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT len(x) AS dim FROM k ORDER BY vec_id LIMIT 1),
p AS (SELECT vec_id, label, part, x[part * dim // {parts} + 1:(part + 1) * dim // {parts}] AS v
      FROM k, w, (SELECT unnest(range({parts})) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64),
b0 AS (SELECT part, entry, v FROM p JOIN f USING (vec_id)),{",".join(steps)},
r AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(best.entry), 2, '0')), '' ORDER BY part) AS code,
             sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
c AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, c"""


OP12_SQL = _op12_sql()


def op13_periodic_runs(spark, sf):
    runs = periodic_runs.find_runs(periodic_runs.with_planted_period(table(spark, sf, "documents")))
    best = runs.withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))"))
    return best.selectExpr(
        "doc_id", "CAST(size(runs) AS BIGINT) AS n_runs", "-best.s AS start", "best.length AS length", "-best.p AS period",
        "CAST(floor(1000 * best.length / -best.p) AS BIGINT) AS exponent_milli",
        r"sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256")


# Runs of six words that occur twice in a document, q words apart, stand side by side along a run with that period.
OP13_SQL = f"""
WITH c AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i:
                  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
k AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD_SQL}'), []) AS w,
             xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, c),
g AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % len(w) AS a FROM k),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] ELSE w END AS w FROM p),
s AS (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 12),
x AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM s),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
e AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m),
f AS (SELECT doc_id, min(i) AS start, count(*) + 5 + q AS length, q FROM e GROUP BY doc_id, q, stretch
      HAVING count(*) + 5 >= q AND count(*) + 5 + q >= 12),
r AS (SELECT doc_id, start, length, min(q) AS period FROM f GROUP BY ALL),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), ''
             ORDER BY start, period) AS said, first(start ORDER BY length DESC, start, period) AS start,
             max(length) AS length, first(period ORDER BY length DESC, start, period) AS period FROM r GROUP BY doc_id),
y AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS pos
                                                     FROM r) GROUP BY doc_id),
z AS (SELECT d.doc_id, CASE WHEN gone IS NULL THEN w ELSE [w[i + 1] FOR i IN range(n) IF NOT list_contains(gone, i)] END
             AS kept FROM d LEFT JOIN y ON d.doc_id = y.doc_id)
SELECT z.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(array_to_string(kept, ' '), '')) AS collapsed_sha256
FROM z LEFT JOIN o ON z.doc_id = o.doc_id"""


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_url_filter": op2_url_filter, "op3_language_model": op3_language_model,
           "op4_fingerprints": op4_fingerprints,
           "op5_jaccard_join": op5_jaccard_join, "op6_warc": op6_warc, "op7_source_mixing": op7_source_mixing, "op8_substring_dedup": op8_substring_dedup,
           "op9_quality": op9_quality,
           "op10_sentencepiece": op10_sentencepiece, "op11_suffix_dedup": op11_suffix_dedup,
           "op12_vector_codes": op12_vector_codes,
           "op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op6_warc": OP6_SQL, "op7_source_mixing": OP7_SQL,
           "op8_substring_dedup": OP8_SQL, "op11_suffix_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL,
           "op13_periodic_runs": OP13_SQL}
