"""URL filter: host-suffix and path-prefix expressions against a rule table.

Every URL is expanded into its host suffixes, which meet the hosts of the rules
on a short hash prefix (confirmed by the full digest); a suffix that rules know
is expanded into the path prefixes of the lengths they have there.  The
expressions ``host suffix + path prefix`` are equi-joined with the rules in the
same way, and the confirmed rules are ranked by length.  Nothing depends on the
number of rules or of their shapes: hosts and rules are tables, broadcast only
if measured small.  DataFrame functions only.

Defined results:

* null url or no ``://``: host and path are empty, no rule fits;
* empty path: only rules with an empty path fit;
* repeated rows are judged row by row; repeated rules count once, and of two
  rules with the same host and path ``block`` wins;
* null host, path or action of a rule: the rule is ignored;
* empty url table: no rows; empty rule table: every url gets ``default``;
* other columns of the url table are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import small_side, spill_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# hex digits of the digest used as the join key
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))


def _digest(expr: Column) -> Column:
    return F.sha2(expr.cast("binary"), 256)


def _keyed(rows: DataFrame, expr: Column, digest: str, prefix: str) -> DataFrame:
    """``rows`` with the digest of ``expr`` and its first digits, the join key."""
    return rows.withColumn(digest, _digest(expr)).withColumn(prefix, F.substring(digest, 1, PREFIX_DIGITS))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): rule text, action, digest, shape, rank."""
    text = F.concat("host", "path")
    return (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
            .groupBy("host", "path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
            .select("host", text.alias("rule"), "action", _digest(text).alias("digest"),
                    F.size(F.split("host", r"\.")).alias("labels"),
                    F.length("path").alias("path_len"), F.length(text).alias("rank")))


def judge_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict)`` for every row of ``urls``.

    ``rules``: host, path, action ('allow' or 'block').  A rule fits its host
    and every subdomain when the url's path starts with the rule's path; the
    longest rule text wins."""
    spec = spill_table(prepare_rules(rules), "url-rules")
    deepest, longest = spec.agg(F.max("labels"), F.max("path_len")).first()
    parsed = urls.select(F.col(key).alias("_key"), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
    if deepest is None:
        return parsed.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
                             F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # what the rules can see of a url: its last labels and its first path characters
    tail = F.substring_index("_host", ".", -(deepest + 1))
    view = parsed.withColumns({"_tail": tail, "_head": F.substring("_path", 1, longest)})
    # hot hosts meet once: distinct (partial) views before the joins
    views = view.select("_tail", "_head").distinct()

    suffixes = F.expr(f"transform(sequence(1, least(size(split(_tail, '[.]')), {deepest})), k -> substring_index(_tail, '.', -k))")
    hosts = spec.groupBy(F.col("host").alias("_rule_host")).agg(F.collect_set("path_len").alias("_lengths"))
    hosts = _keyed(hosts, F.col("_rule_host"), "_host_digest", "_host_prefix")
    suffixed = _keyed(views.select("_tail", "_head", F.explode(suffixes).alias("_suffix")), F.col("_suffix"), "_full", "_host_prefix")
    known = (suffixed.join(small_side(hosts, "_rule_host"), "_host_prefix").where(F.col("_full") == F.col("_host_digest"))
             .select("_tail", "_head", "_suffix", F.explode("_lengths").alias("_n")).where(F.length("_head") >= F.col("_n")))
    expressed = known.select("_tail", "_head", F.concat("_suffix", F.expr("substring(_head, 1, _n)")).alias("_expr"))
    keyed = small_side(spec.select("rule", "action", "rank", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("_prefix")), "rule")
    hits = (_keyed(expressed, F.col("_expr"), "_full", "_prefix").join(keyed, "_prefix").where(F.col("_full") == F.col("digest"))
            .groupBy("_tail", "_head")
            .agg(F.max(F.struct("rank", "rule", "action")).alias("_best")))
    hits = spill_table(hits, "url-hits")  # its own exchange, so that AQE can split hot views
    judged = view.join(hits, ["_tail", "_head"], "left")
    return judged.select(
        F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
