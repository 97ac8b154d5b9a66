"""Registered queries that meet pages with very many rules at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions import text as tx
from eventboard.operators import pages as pg
from eventboard.operators import rulematch as rm
from eventboard.plans.pagequeries import LINKS_SQL
from eventboard.plans.pagequeries import ORACLES as PAGE_ORACLES
from eventboard.plans.tables import spread, table
from eventboard.session import stored


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("html").alias("body"))


def rules_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page is a rule whose keywords are the words of its text: how many rules does each page meet?"""
    pages = _pages(spark, sf_dir)
    links = pg.extract_links(pages, keys=["page_id"])
    rules = links.select(F.concat_ws("-", "page_id", "pos").alias("rule_id"), F.split("text", " ").alias("keywords"))
    texts = pages.select("page_id", tx.page_text(F.col("body"), F.lit("http")).alias("text"))
    classes = stored(rm.rule_classes(rules).select("keywords", F.struct("keywords", "n_rules").alias("rule_id")), "rule-classes")
    met = rm.match_keywords(texts, classes, ["page_id"])
    return met.groupBy("page_id").agg(F.sum("rule_id.n_rules").alias("n_rules"))


def rules_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page brings a rule, for its host, for its section or for nowhere; every page is a load that one may read."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    host, section = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.regexp_extract("url", "^[a-z]+://[^/?#]*/[^/?#]*", 0)
    rules = pages.select(
        k.alias("rule_id"),
        F.when(k % 3 == 0, F.concat(F.upper(host), F.lit("/"))).when(k % 3 == 1, section).otherwise(F.concat(F.lit("https://none.example/"), k)).alias("url_prefix"),
        F.when(k % 4 == 1, "browser").alias("fetch_mode"),
    )
    loads = pages.select(
        "page_id",
        F.when(k % 11 != 0, F.col("url")).alias("requested_url"),
        F.when(k % 5 == 0, F.concat(F.lit("https://none.example/"), k, F.lit("/moved/"))).alias("final_url"),
        F.when(k % 2 == 0, "http").otherwise("browser").alias("fetch_mode"),
    )
    return rm.bind_by_prefix(loads, rules, ["page_id"])


QUERIES = {"rules_by_keyword": rules_by_keyword, "rules_by_prefix": rules_by_prefix}


def _key(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({c}), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    whole = f"lower(regexp_extract({bare}, '^[^/]*')) || regexp_extract({bare}, '^[^/]*(.*)$', 1)"
    return f"nullif(regexp_replace({whole}, '/+$', ''), '')"


ORACLES = {
    "rules_by_keyword": f"""WITH {LINKS_SQL}, texts AS ({PAGE_ORACLES['page_text']}),
rules AS (SELECT DISTINCT page_id || '-' || pos AS rule_id, lower(unnest(string_split(text, ' '))) AS word FROM links),
w AS (SELECT DISTINCT word FROM rules WHERE word <> ''),
hits AS (SELECT t.page_id, w.word FROM texts t JOIN w ON contains(lower(t.text), w.word))
SELECT page_id, count(DISTINCT rule_id) AS n_rules FROM hits JOIN rules USING (word) GROUP BY page_id""",
    "rules_by_prefix": f"""WITH r AS (SELECT page_id AS rule_id, CASE page_id % 3 WHEN 0 THEN upper(regexp_extract(url, '^[a-z]+://[^/?#]*')) || '/'
    WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/?#]*/[^/?#]*') ELSE 'https://none.example/' || page_id END AS url_prefix,
    CASE WHEN page_id % 4 = 1 THEN 'browser' END AS mode FROM pages),
rk AS (SELECT *, {_key('url_prefix')} AS p FROM r),
l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http' ELSE 'browser' END AS mode,
    CASE WHEN page_id % 11 <> 0 THEN url END AS u, CASE WHEN page_id % 5 = 0 THEN 'https://none.example/' || page_id || '/moved/' END AS f FROM pages),
lk AS (SELECT page_id, mode, {_key('u')} AS k, 0 AS second FROM l UNION ALL SELECT page_id, mode, {_key('f')}, 1 FROM l),
m AS (SELECT lk.page_id, rule_id, url_prefix, p, second, rk.mode IS NULL AS any_mode, rk.mode IS NULL OR rk.mode = lk.mode AS fits
  FROM lk JOIN rk ON lk.k = rk.p OR starts_with(lk.k, rk.p || '/')),
b AS (SELECT * FROM m WHERE fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(p) DESC, second, any_mode, rule_id) = 1),
n AS (SELECT page_id, max(k) IS NULL AS bare FROM lk GROUP BY page_id)
SELECT n.page_id, b.rule_id, b.url_prefix, CASE WHEN b.page_id IS NOT NULL THEN NULL WHEN bare THEN 'no url'
  WHEN n.page_id IN (SELECT page_id FROM m) THEN 'other mode' ELSE 'no rule for the url' END AS reason
FROM n LEFT JOIN b USING (page_id)""",
}
