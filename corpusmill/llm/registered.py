"""The registered queries: each operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    collocations, filter_audit, fingerprints, language_id, language_model, line_dedup, mixing, near_dedup, packing,
    quality_rules, secret_scan, suffix_dedup, token_counts,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hyperdimensional_language(spark, sf_dir):
    return language_id.identify(_documents(spark, sf_dir))


def op2_minhash_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir), size=2)


def op3_line_alignment(spark, sf_dir):
    return line_dedup.drop_repeated_lines(_documents(spark, sf_dir))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_documents(spark, sf_dir))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(_documents(spark, sf_dir))


def op6_context_tree(spark, sf_dir):
    return language_model.score(_documents(spark, sf_dir))


def op7_secret_crf(spark, sf_dir):
    return secret_scan.find_secrets(_documents(spark, sf_dir))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality(_documents(spark, sf_dir))


def op9_simhash(spark, sf_dir):
    done = fingerprints.with_edits(_documents(spark, sf_dir))
    asked = F.col("doc_id") % 100 == 0
    near = fingerprints.near_fingerprints(done.select("doc_id", "fingerprint"), asked)
    # Asked fingerprints are a hundredth of the rows; only these rows need the join.
    return done.join(near, "fingerprint", "left").withColumn("n_within", F.when(asked, F.col("n_within")))


def op10_fair_mix(spark, sf_dir):
    return mixing.fair_mix(_documents(spark, sf_dir)).drop("finish", "n_copies")


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_suffix_merge(spark, sf_dir):
    return suffix_dedup.drop_repeated_bytes(_documents(spark, sf_dir))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hyperdimensional_language, op2_minhash_dedup, op3_line_alignment, op4_best_fit_packing, op5_token_counts,
        op6_context_tree, op7_secret_crf, op8_quality_rules, op9_simhash, op10_fair_mix, op11_filter_audit,
        op12_suffix_merge, op13_collocations,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {}

ORACLES["op10_fair_mix"] = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS size, coalesce('0' || source, '1') AS src,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, coalesce(CAST(doc_id AS VARCHAR), '') AS tie
  FROM documents),
sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS place FROM sized GROUP BY src),
weighed AS (
  SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM sources),
filled AS (
  SELECT *, sum(cap) OVER up + cap / weight * (sum(weight) OVER () - sum(weight) OVER up) <= budget AS dry FROM weighed
  WINDOW up AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT *, CASE WHEN dry THEN cap ELSE
    (budget - coalesce(sum(CASE WHEN dry THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT dry THEN weight END) OVER () * weight
    END AS target FROM filled),
queued AS (
  SELECT *, sum(size) OVER (PARTITION BY src ORDER BY key, tie ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized JOIN targets USING (src)),
copies AS (
  SELECT doc_id, size, place, budget, (sent + epoch * source_size) / weight AS finish
  FROM (SELECT *, unnest([0, 1]) AS epoch FROM queued WHERE size > 0)),
sent AS (
  SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS used FROM copies),
taken AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM sent WHERE used <= budget GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken
FROM queued LEFT JOIN taken USING (doc_id)"""


ORACLES["op11_filter_audit"] = rf"""
WITH marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
rows_ AS (
  SELECT d.doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, coalesce(good, false) AS good,
    coalesce(toxic, false) AS toxic, regexp_extract_all(coalesce(text, ''), '{filter_audit.WORD}') AS w,
    min(d.doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
  FROM documents d LEFT JOIN marks USING (doc_id)),
failed AS (
  SELECT part, good, toxic,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '{filter_audit.SYMBOLS}') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > low THEN 'E' ELSE '' END) AS fails FROM rows_),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failed GROUP BY 1, 2),
walked AS (
  SELECT part, filter_order, step, x, n, n_good, n_toxic, fails, contains(fails, x) AS here,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (here AND NOT gone), 0) AS good_lost,
    coalesce(sum(n_toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM walked GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""

ORACLES["op12_suffix_merge"] = """
WITH held AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
strings AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM held WHERE n >= 50)),
low AS (SELECT s, min(doc_id) AS low FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM strings JOIN low USING (s) WHERE doc_id > low),
marked AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) BETWEEN 0 AND 50 AS goes_on FROM hits),
numbered AS (
  SELECT doc_id, p, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY 1, 2),
between_ AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM between_ JOIN held USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM held LEFT JOIN cut USING (doc_id)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op13_collocations"] = rf"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, i, unnest(range(1, 5)) AS k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0))
  WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
often AS (SELECT * FROM counted WHERE f >= 30),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY 1),
cuts AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
halves AS (
  SELECT c.*, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, a, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (
    SELECT lang, a, w, unnest(range(2, len(w))) AS k FROM best WHERE len(w) > 2)) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN total USING (lang) LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE o.longest IS NULL OR 100 * o.longest < 80 * a
QUALIFY rank <= 2000"""
