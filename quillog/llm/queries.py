"""Registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillog.session import table

from . import decontam, html_extract, lang_crf, licence_scan, line_dedup, minhash_icws, periodic_runs, piece_codec, sharding, source_audit, span_dedup, url_filter, vector_dedup


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_size(table(spark, sf_dir, "documents"), 24)
    return shards.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lang_crf.learn(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    tagged = lang_crf.predict(docs.select("doc_id", "text"), model)
    return tagged.select(
        "doc_id", held_out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_n_words").alias("n_words")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_extract.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_table(table(spark, sf_dir, "documents"))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    flagged = decontam.flag(docs, table(spark, sf_dir, "benchmark"))
    return flagged.select(
        "doc_id",
        F.col("_contaminated").alias("contaminated"),
        F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("_coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce(~F.col("_same_slots"), F.lit(False)).alias("reparameterised"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash_icws.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.withColumn("kept", F.col("doc_id") == F.col("group_id"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    begin = lambda n: g % n
    period = lambda n: 1 + F.floor((n - begin(n)) / (3 + g % 8))
    text = F.when(h % 10 == 0, periodic_runs.repeat_tail(F.col("text"), begin, period)).otherwise(F.col("text"))
    found = periodic_runs.find(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = periodic_runs.strongest(F.col("_runs"))
    lines = F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("_runs").cast("bigint").alias("n_runs"), best.alias("_best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = span_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(doc_id > f, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::int) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _starts(phrase: str) -> str:
    want = phrase.split()
    fits = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(want))
    return f"[i - 1 FOR i IN range(1, len(ws) + 1) IF {fits}]"


def _op9_sql() -> str:
    rows = []
    for label, text in licence_scan.TEMPLATES:
        words = sorted(set(licence_scan._words(text)))
        others = {w for other, t in licence_scan.TEMPLATES if other != label for w in licence_scan._words(t)}
        alone = [w for w in words if w not in others]
        names = [w for w in words if w in licence_scan.NAMES.get(label, "").split()]
        rows.append(f"({len(rows)}, '{label}', {words!r}, {len(words)}, {math.ceil(0.8 * len(words) - 1e-9)}, {alone!r}::varchar[], {math.ceil(0.8 * len(alone) - 1e-9)}, {names!r}::varchar[])")
    starts = ", ".join(f"{_starts(p)} AS s{k}" for k, (p, _) in enumerate(licence_scan.PHRASES))
    base = ", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licence_scan.PHRASES))
    every = ", ".join(f"s{k}" for k in range(len(licence_scan.PHRASES)))
    return f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
w AS (SELECT doc_id, {_WORDS.format("t")} AS ws FROM d),
s AS (SELECT doc_id, len(ws) AS n_words, {starts} FROM w),
b AS (SELECT doc_id, n_words, flatten([{every}]) AS places, [x FOR x IN [{base}] IF x IS NOT NULL] AS base FROM s),
blocks AS (SELECT doc_id, row_number() OVER () AS b, list_distinct({_WORDS.format("unnest(string_split(regexp_replace(regexp_replace(t, '(?m)^([^\\n]{0,39})\\n', '\\1' || chr(1), 'g'), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)))")}) AS ws FROM d),
tpl(k, label, own, n, need, alone, alone_need, names) AS (VALUES {", ".join(rows)}),
hits AS (SELECT doc_id, b, k, label, list_intersect(ws, own) AS found, n FROM blocks JOIN tpl ON len(list_intersect(ws, own)) >= need AND len(list_intersect(ws, alone)) >= alone_need AND list_has_all(ws, names)),
met AS (SELECT doc_id, label, len(found) / n AS c FROM hits x WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.b = x.b AND y.label <> x.label AND len(y.found) > len(x.found) AND list_has_all(y.found, x.found))),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM met GROUP BY 1)
SELECT b.doc_id, n_words, len(places)::bigint AS n_base, list_min(places)::bigint AS first_word, list_max(places)::bigint AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0) END AS score
FROM b LEFT JOIN more USING (doc_id)
"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY 1, 2, 3),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * max(v)) AS q FROM c JOIN v USING (lang) GROUP BY 1, 2),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::bigint FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::int AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest([md5(array_to_string(ws[i + 1:i + 50], ' ')) FOR i IN range(0, len(ws) - 49)]) AS h, unnest(range(0, len(ws) - 49)) AS i FROM d),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (h) WHERE doc_id > first),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY 1),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_html_extraction": op2_html_extraction,
    "op3_pieces": op3_pieces,
    "op4_vector_near_dedup": op4_vector_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_licence_scan": op9_licence_scan,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_audit": op12_source_audit,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op9_licence_scan": _op9_sql(), "op12_source_audit": OP12_SQL, "op13_substring_dedup": OP13_SQL}
