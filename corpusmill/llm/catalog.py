"""Registered queries of this subpackage: one ``opN_<name>`` per operator.

Each query is a thin call of its operator over the whole table; digest columns
the contracts ask for are derived here from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import language_id, pii_anchors, secret_ledger
from corpusmill.llm.bpe_tree import bpe_round_trip
from corpusmill.llm.common import table
from corpusmill.llm.importance import resample
from corpusmill.llm.lattice_dedup import lattice_links
from corpusmill.llm.line_dedup import MIN_CHARS, MIN_DOCUMENTS, drop_lines
from corpusmill.llm.lpf_dedup import repeated_spans
from corpusmill.llm.middle_fill import FIM_PERCENT, MIDDLE, PREFIX, SEED, SPM_PERCENT, SUFFIX, fill_in_middle
from corpusmill.llm.simhash_vptree import simhash_components
from corpusmill.llm.spans import span_columns
from corpusmill.llm.template_decontam import LITERALS, MARKS, NAME, NUMBER, SIMILARITY, TOKEN, UNIT, UNITS, WIDTH, contaminated
from corpusmill.llm.url_rules import UPPER, judge_urls
from corpusmill.llm.warc_shards import read_warc, write_warc
from corpusmill.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


# ---- 1: benchmark decontamination ------------------------------------------

_MARKS = ", ".join("chr(10)" if m == "\n" else f"'{m}'" for m in MARKS)
_HOLDERS = f"('{NUMBER}', '{UNIT}', '{NAME}')"


def _words_sql(source: str, key: str) -> str:
    """DuckDB: (k, id, words) of every distinct text; a word has its template
    form n, its plain form p, the token r and whether it begins a sentence, f."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    name = f"""CASE WHEN x[1] BETWEEN '0' AND '9' THEN '{NUMBER}' WHEN lower(x) <> x THEN '{NAME}'
        WHEN i > 1 AND tk[i - 1][1] BETWEEN '0' AND '9' AND lower(x) IN ({units}) THEN '{UNIT}' ELSE lower(x) END"""
    return f"""SELECT k, id, list_filter(list_transform(tk, lambda x, i: {{'n': {name}, 'p': CASE WHEN x NOT IN ({_MARKS}) THEN lower(x) END, 'r': x,
      'f': i = 1 OR tk[i - 1] IN ({_MARKS})}}), lambda s: s.p IS NOT NULL) AS words
  FROM (SELECT k, row_number() OVER () AS id, regexp_extract_all(text, '{TOKEN}') AS tk
    FROM (SELECT DISTINCT {key} AS k, coalesce(text, '') AS text FROM {source} WHERE {key} IS NOT NULL))"""


def _windows_sql(words: str, lengths: str, names: str) -> str:
    """(k, id, reading, pos, win, slots): plain windows of the lengths, and
    those of the names reading that ``names`` admits."""
    return f"""SELECT k, id, 'plain' AS reading, pos, [s.p FOR s IN part] AS win, NULL AS slots
  FROM (SELECT k, id, pos, words[pos + 1:pos + w] AS part FROM (
    SELECT k, id, words, w, unnest(range(greatest(len(words) - w + 1, 1))) AS pos FROM (SELECT k, id, words, unnest({lengths}) AS w FROM {words}) WHERE len(words) > 0))
  UNION ALL SELECT k, id, 'names', pos, [s.n FOR s IN part], [{{'t': s.n, 'v': s.r, 'f': s.f}} FOR s IN part IF s.n IN {_HOLDERS}]
  FROM (SELECT k, id, pos, words[pos + 1:pos + {WIDTH}] AS part FROM (
    SELECT k, id, words, unnest(range(len(words) - {WIDTH - 1})) AS pos FROM {words} WHERE len(words) >= {WIDTH})) WHERE {names}"""


@query("op1_template_decontam", f"""
WITH dw AS MATERIALIZED ({_words_sql("documents", "doc_id")}),
bw AS MATERIALIZED ({_words_sql("(SELECT * FROM benchmark WHERE text IS NOT NULL)", "item_id")}),
b AS MATERIALIZED ({_windows_sql("bw", f"[{WIDTH}]", f"len([s.n FOR s IN part IF s.n NOT IN {_HOLDERS}]) > 0 AND len([s.n FOR s IN part IF s.n NOT IN ('{NUMBER}', '{NAME}')]) >= {LITERALS}")}),
lens AS (SELECT list_distinct([{WIDTH}] || coalesce(list(len(words)) FILTER (WHERE len(words) BETWEEN 1 AND {WIDTH - 1}), [])) AS ls FROM bw),
d AS MATERIALIZED ({_windows_sql("dw", "(SELECT ls FROM lens)", "true")}),
sizes AS (SELECT id AS bid, count(*) AS n FROM b WHERE reading = 'plain' GROUP BY 1),
met AS MATERIALIZED (SELECT d.k AS doc_id, d.id AS did, b.k AS item_id, b.id AS bid, reading, d.pos, b.pos AS ipos, d.slots AS ds, b.slots AS bs FROM d JOIN b USING (reading, win)),
counts AS (SELECT doc_id, did, item_id, bid, n, count(DISTINCT ipos) FILTER (WHERE reading = 'plain') AS n_plain, count(DISTINCT ipos) AS n_any
  FROM met JOIN sizes USING (bid) GROUP BY ALL),
todo AS (SELECT did, bid FROM counts WHERE n_any >= n * {SIMILARITY} AND n_plain < n * {SIMILARITY}),
al AS MATERIALIZED (SELECT did, bid, pos - ipos AS shift, ipos, bs, ds FROM met JOIN todo USING (did, bid) WHERE reading = 'names'),
val0 AS (SELECT did, bid, shift, ipos, z[1].t AS t, z[1].v AS f, z[2].v AS g, z[1].f OR z[2].f AS first FROM (SELECT did, bid, shift, ipos, unnest(list_zip(bs, ds)) AS z FROM al)),
swapped AS (SELECT did, bid, shift, ipos, unnest([lower(f), lower(g)]) AS word FROM val0 WHERE t = '{NAME}' AND first AND f <> g),
texts AS (SELECT coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
forms AS (SELECT unnest(list_distinct(list_filter(list_transform(tk, lambda x, i: CASE WHEN x IN ({_MARKS}) OR x[1] BETWEEN '0' AND '9' THEN NULL
    WHEN lower(x) = x THEN x WHEN i > 1 AND tk[i - 1] NOT IN ({_MARKS}) THEN '#' || lower(x) END), lambda x: x IS NOT NULL))) AS form
  FROM (SELECT regexp_extract_all(text, '{TOKEN}') AS tk FROM texts WHERE EXISTS (SELECT 1 FROM swapped))),
ordinary AS (SELECT ltrim(form, '#') AS word FROM forms GROUP BY 1 HAVING count(*) > 2 * count(*) FILTER (WHERE form[1] = '#')),
barred AS (SELECT DISTINCT did, bid, shift, ipos FROM swapped JOIN ordinary USING (word)),
val AS (SELECT * FROM val0 ANTI JOIN barred USING (did, bid, shift, ipos)),
cnt AS (SELECT did, bid, shift, t, f, g, count(*) AS n FROM val GROUP BY ALL),
pick AS (SELECT did, bid, shift, t, f, max({{'n': n, 'g': g}}).g AS g FROM cnt GROUP BY ALL),
bad AS (SELECT DISTINCT v.did, v.bid, v.shift, v.ipos FROM val v JOIN pick p USING (did, bid, shift, t, f) WHERE v.g <> p.g),
good AS (SELECT did, bid, ipos FROM al ANTI JOIN barred USING (did, bid, shift, ipos) ANTI JOIN bad USING (did, bid, shift, ipos)
  UNION SELECT did, bid, ipos FROM met JOIN todo USING (did, bid) WHERE reading = 'plain'),
ok AS (SELECT did, bid, count(DISTINCT ipos) AS m FROM good GROUP BY ALL),
changed AS (SELECT did, bid, count(DISTINCT (t, f)) AS c FROM pick WHERE f <> g GROUP BY ALL),
held AS (SELECT doc_id, item_id, n, n_plain AS m, 0 AS c FROM counts WHERE n_plain >= n * {SIMILARITY}
  UNION ALL SELECT doc_id, item_id, n, ok.m, coalesce(changed.c, 0) FROM counts JOIN ok USING (did, bid) LEFT JOIN changed USING (did, bid)
  WHERE n_plain < n * {SIMILARITY} AND ok.m >= n * {SIMILARITY})
SELECT doc_id, item_id, x.n AS n_windows, x.m AS n_matched, x.s AS similarity, x.c AS n_changed
FROM (SELECT doc_id, item_id, max({{'s': m / n, 'n': n, 'm': m, 'c': c}}) AS x FROM held GROUP BY ALL)""")
def op1_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- 4: URL filter ---------------------------------------------------------

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _rules_values() -> str:
    return ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)


@query("op4_url_filter", f"""
WITH rest AS (SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parsed AS (SELECT rid, page_id, translate(coalesce(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
    coalesce(regexp_extract(r, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM rest),
rules AS (SELECT * FROM (VALUES {_rules_values()}) AS t(rhost, rpath, action))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    coalesce(arg_max(action, length(rhost || rpath)), 'allow') AS verdict
FROM parsed LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY rid, page_id""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_rules_values()} AS t(host, path, action)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


# ---- 2: personal data ------------------------------------------------------

@query("op2_pii_anchors")
def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_anchors.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_columns(F.col("spans"), pii_anchors.BASE_KINDS))


# ---- 8: secrets ------------------------------------------------------------

@query("op8_secret_ledger")
def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan_versions(table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger"))
    return found.select("doc_id", *span_columns(F.col("findings"), secret_ledger.BASE_KINDS))


# ---- 3: language -----------------------------------------------------------

@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# ---- 5: embedding near-duplicates ------------------------------------------

@query("op5_lattice_dedup")
def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links(table(spark, sf_dir, "embeddings"))


# ---- 6: byte-level BPE -----------------------------------------------------

@query("op6_bpe_tree")
def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# ---- 10: SimHash near-duplicates -------------------------------------------

@query("op10_simhash_vptree")
def op10_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- 7: repeated passages --------------------------------------------------

@query("op7_lpf_dedup")
def op7_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# ---- 9: WARC ---------------------------------------------------------------

@query("op9_warc_shards", """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(html) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(html) >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM pages)""")
def op9_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---- 11: line dedup --------------------------------------------------------

@query("op11_line_dedup", f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key, true AS gone FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY rid, doc_id""")
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# ---- 12: importance resampling ---------------------------------------------

@query("op12_importance_resampling")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


# ---- 13: fill in the middle ------------------------------------------------

@query("op13_fill_in_middle", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
        WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
        ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return fill_in_middle(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
