"""Registered queries over the given pages: text, links, titles, cards and elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions import predicates as pr
from eventboard.functions import text as tx
from eventboard.operators import pages as pg
from eventboard.operators import pick
from eventboard.plans.tables import spread, table

KEYS = ["page_id"]
WORDS = ["que", "der", "the"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("html").alias("body"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", tx.page_text(F.col("body"), F.lit("http")).alias("text"))


def page_text_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id", tx.html_to_text(tx.strip_noise(F.col("body")), sep="").alias("text")
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.extract_links(_pages(spark, sf_dir), keys=KEYS)


def page_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links, without their query, that are not the listing itself."""
    links = pg.extract_links(_pages(spark, sf_dir), keys=["page_id", "url"])
    resolved = links.withColumn("absolute", tx.resolve_url(F.col("href"), F.col("url"), cut_query=True))
    kept = resolved.filter(pr.not_listing(F.col("absolute"), F.col("url"), F.col("url"), "page="))
    return kept.select("page_id", "pos", "absolute", pr.url_like(F.col("absolute"), r"/[a-z]+$").alias("lower_path"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.first_title(_pages(spark, sf_dir), keys=KEYS)


def page_first_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three links of each page, marked where a keyword or a version number occurs."""
    first = F.slice(pg.links_of(F.col("body")), 1, 3)
    links = _pages(spark, sf_dir).select("page_id", F.inline(first))
    return links.select(
        "page_id",
        "pos",
        "text",
        pr.matches_any(F.col("text"), WORDS).alias("keyword"),
        pr.is_release_title(F.col("text"), WORDS).alias("release"),
    )


def page_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    def wanted(link):
        return link["href"].isNotNull() & (link["href"] != "") & pr.matches_any(link["text"], WORDS)

    first = pick.first_in(pg.links_of(F.col("body")), wanted)
    links = _pages(spark, sf_dir).select("page_id", first.alias("link")).filter("link IS NOT NULL")
    return links.select("page_id", "link.*")


def page_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("page_id", pg.links_of(F.col("body")).alias("links")).filter(F.size("links") > 0)
    counts = pick.relevant_in(
        F.col("links"), lambda i: pr.matches_any(i["text"], WORDS), lambda i: F.nullif(i["href"], F.lit("/The")).isNotNull()
    )
    return pages.select("page_id", *counts)


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors and headings through the element parser, in document order."""
    found = pg.extract_elements(_pages(spark, sf_dir), ["a", "h1"], keys=KEYS)
    return found.select("page_id", "tag", tx.strip(F.col("text")).alias("text"), F.col("attrs")["href"].alias("href"))


def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with the text of their enclosing list item."""
    near = pg.with_context(_pages(spark, sf_dir), ["a"], ["li"], keys=KEYS)
    return near.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(F.col("card_text") == F.col("text")).alias("alone_in_item"),
        F.count_if(F.contains("context", "text")).alias("in_context"),
    )


_NOISE = r"""regexp_replace(regexp_replace({c}, '(?is)<script\b[^>]*>.*?</script>', '', 'g'),
  '(?is)<style\b[^>]*>.*?</style>', '', 'g')"""
_SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _decode(c: str) -> str:
    for entity, char in tx.ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def _joined(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace({_NOISE.format(c=c)}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>?', '', 'g')"
    return _decode(bare)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


LINKS_SQL = rf"""anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) AS anchor,
    generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>'), 1) - 1 AS pos
  FROM pages
), links AS (
  SELECT page_id, url, CAST(pos AS INTEGER) AS pos,
    nullif(trim({_decode("regexp_extract(anchor, '(?is)^<a[^>]*\\shref\\s*=\\s*" + '"([^"]*)"' + "', 1)")}), '') AS href,
    {_strip(_joined('anchor'))} AS text
  FROM anchors
)"""

_ABSOLUTE = r"""split_part(CASE WHEN href IS NULL OR href LIKE '#%' THEN NULL
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href
  WHEN href LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || href
  ELSE regexp_extract(regexp_extract(url, '^[^?#]*'), '^[a-z]+://[^/]*/(?:.*/)?') || href END, '?', 1)"""

_HEADING = r"regexp_extract(html, '(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>', 1)"

_ANY = " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS)

QUERIES = {
    "page_text": page_text,
    "page_text_joined": page_text_joined,
    "page_links": page_links,
    "page_links_resolved": page_links_resolved,
    "page_titles": page_titles,
    "page_first_cards": page_first_cards,
    "page_first_link": page_first_link,
    "page_relevant": page_relevant,
    "page_elements": page_elements,
    "page_cards": page_cards,
}

ORACLES = {
    "page_text": rf"""SELECT page_id, trim(regexp_replace(regexp_replace({_NOISE.format(c='html')}, '<[^>]*>?', ' ', 'g'),
  '{_SPACE}', ' ', 'g')) AS text FROM pages""",
    "page_text_joined": f"SELECT page_id, {_joined('html')} AS text FROM pages",
    "page_links": f"WITH {LINKS_SQL} SELECT page_id, pos, href, text FROM links",
    "page_links_resolved": f"""WITH {LINKS_SQL}, resolved AS (SELECT page_id, url, pos, {_ABSOLUTE} AS absolute FROM links)
SELECT page_id, pos, absolute, regexp_matches(absolute, '/[a-z]+$') AS lower_path FROM resolved
WHERE absolute IS DISTINCT FROM url AND NOT coalesce(contains(absolute, 'page='), false)""",
    "page_titles": rf"""SELECT page_id, nullif({_strip(_joined(_HEADING))}, '')
  AS title FROM pages""",
    "page_first_cards": rf"""WITH {LINKS_SQL}
SELECT page_id, pos, text, {_ANY} AS keyword, ({_ANY} OR regexp_matches(text, '\d+\.\d+')) AS release
FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3""",
    "page_first_link": f"""WITH {LINKS_SQL} SELECT page_id, pos, href, text FROM links
WHERE href IS NOT NULL AND ({_ANY}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1""",
    "page_relevant": f"""WITH {LINKS_SQL}, n AS (
  SELECT page_id, count(*) FILTER (WHERE {_ANY}) AS relevant,
    count(*) FILTER (WHERE ({_ANY}) AND nullif(href, '/The') IS NOT NULL) AS dated FROM links GROUP BY page_id)
SELECT *, dated = 0 AS next_channel FROM n""",
    "page_elements": rf"""WITH {LINKS_SQL}, heads AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>')) AS h FROM pages)
SELECT page_id, 'a' AS tag, text, href FROM links
UNION ALL SELECT page_id, 'h1', {_strip(_joined('h'))}, NULL FROM heads""",
    "page_cards": f"""WITH {LINKS_SQL} SELECT page_id, count(*) AS links, count(*) AS alone_in_item,
  count(*) AS in_context FROM links GROUP BY page_id""",
}
