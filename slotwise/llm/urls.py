"""URL filter: allow/block rules first, then token combinations mined from labels with FP-growth.

Everything here is DataFrame expressions and Spark's own FP-growth; no Python runs on the executors.

Defined results: a null url or one without `://` has an empty host and path, no tokens and no rule, so it is allowed;
repeated page rows give repeated result rows; an empty label table gives no mined rules; other columns of `pages` and
`labels` are never read, so clashing names do not matter.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep, table, with_values

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.005      # share of labelled urls that must carry the tokens and the block label
MIN_CONFIDENCE = 0.6     # share of the urls with the tokens that carry the block label
BLOCKED = "!blocked"     # the class item; no token looks like it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels, path pieces without their digits, query keys, scheme."""
    flat = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    part = lambda c, cut, tag: F.transform(F.filter(F.split(c, cut), lambda x: x != ""), lambda x: F.concat(F.lit(tag), flat(x)))
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), flat(F.regexp_extract(x, "^([^=]*)", 1))))
    return F.array_distinct(F.concat(part(host, r"\.", "h:"), part(path, "/", "p:"), keys))


def match_lists(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest list entry that fits; null where none does."""
    found = []
    for verdict, rule in rules:
        rule_host, rule_path = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*found)))
    return best["rule"], best["verdict"]


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence) that predict a block from `labelled` (tokens array, blocked boolean), mined by FP-growth.

    Rules of every length stay: a combination can reach the confidence where none of its parts does.
    """
    items = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    return (model.associationRules.where(F.col("consequent")[0] == BLOCKED)
                 .select(F.col("antecedent").alias("tokens"), "confidence"))


def rule_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Inverted index: each rule is posted once, under its rarest token among the labelled urls."""
    seen = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.withColumn("rule_id", F.array_join(F.array_sort("tokens"), " ")).select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    return (posted.join(seen, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("rule_tokens"), F.max("confidence").alias("confidence"))
                  .select("token", "rule_tokens", "confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence of the best mined rule (null where none fits).

    A page's label is that of the document with the same id; `quality = 0` means block.
    """
    p = pages.select("page_id", "url")
    host, path = url_parts(F.col("url"))
    parts = p.select("page_id", "url", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    known = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked")).where(F.col("blocked").isNotNull())
    known = known.groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = keep(parts.join(known, "page_id").select("tokens", "blocked"))
    index = rule_index(mine_rules(labelled, min_support, min_confidence), labelled)
    # the mined verdict depends on the url alone, so it is found once per distinct token set and joined back
    sets = keep(parts.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")))
    hits = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
                .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
                .groupBy("tokens").agg(F.max("confidence").alias("confidence")))
    rule, verdict = match_lists(F.col("host"), F.col("path"), rules)
    return (with_values(parts, hits, "tokens", sets)
                 .select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence"))


def op8_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.withColumn("confidence", F.round("confidence", 9))


OP8_SQL = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
tok AS (
  SELECT *, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '0', 'g')),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
    list_transform(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), ''), '&'), lambda x: x <> ''),
      lambda x: 'q:' || regexp_replace(regexp_extract(x, '^([^=]*)', 1), '[0-9]+', '0', 'g')))) AS tokens
  FROM hp),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
lab AS (SELECT row_number() OVER () AS id, tokens, bad FROM tok JOIN known USING (page_id)),
t AS (SELECT id, bad, unnest(tokens) AS x FROM lab),
need AS (SELECT ceil({MIN_SUPPORT} * count(*)) AS least FROM lab),
often AS (SELECT x FROM t, need GROUP BY x, least HAVING sum(bad) >= greatest(least, 1)),
held AS (SELECT id, any_value(bad) AS bad, list(x ORDER BY x) AS xs FROM t JOIN often USING (x) GROUP BY id),
parts_of AS (SELECT bad, unnest(list_transform(range(1, 1 << len(xs)), lambda m: list_filter(xs, lambda x, i: (m >> (i - 1)) & 1 = 1))) AS s FROM held),
rules AS (SELECT s, CAST(sum(bad) AS DOUBLE) / count(*) AS conf FROM parts_of, need GROUP BY s, least
  HAVING sum(bad) >= greatest(least, 1) AND CAST(sum(bad) AS DOUBLE) / count(*) >= {MIN_CONFIDENCE}),
fits AS (SELECT page_id, url, max(conf) AS conf FROM tok JOIN rules ON list_has_all(tokens, s) GROUP BY 1, 2),
lists AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)}) v(verdict, rule, rh, rp)),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(l.verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM hp) d JOIN lists l
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2)
SELECT page_id, host, path, best.rule, coalesce(best.verdict, CASE WHEN fits.conf IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, round(fits.conf, 9) AS confidence
FROM tok LEFT JOIN best USING (host, path) LEFT JOIN fits USING (page_id, url)"""
