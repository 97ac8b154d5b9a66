"""Which of very many rules a text or a url meets, by an index from the rules' own words and prefixes.

Testing every rule's list on every page costs pages times rules. Here the short side is indexed: a keyword by its first
``GRAM`` characters, a url prefix by itself. A text unfolds into the windows that begin at each of its characters, once per
distinct window, a url into the prefixes that end at its slashes; both meet the index in one equi-join, and a keyword is
then compared with the window it met. A keyword without a space lies between two spaces of a text, so it is looked for in
the distinct pieces of all texts, and only one with a space in the windows of the texts themselves. Texts do not travel,
only their pieces and windows; a word that many rules share is joined to them after its pages have been told apart.

Rules that say the same are one class with a number of members (``rule_classes``): pages meet classes, so a thousand rules
with the same keywords cost what one costs. Likewise only the smallest rule of a prefix and mode can ever be bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def keywords(rules: DataFrame, rule: str = "rule_id", words: str = "keywords") -> DataFrame:
    """``rule, word`` of all rules, each word once and in lower case; empty words are none."""
    each = rules.select(F.col(rule).alias("rule"), F.explode(words).alias("word"))
    return each.select("rule", F.lower("word").alias("word")).filter("word <> ''").distinct()


def rule_classes(rules: DataFrame, rule: str = "rule_id", words: str = "keywords") -> DataFrame:
    """``keywords, n_rules``: the sets of words that rules are made of, and how many rules have each."""
    whole = keywords(rules, rule, words).groupBy("rule").agg(F.sort_array(F.collect_set("word")).alias("keywords"))
    return whole.groupBy("keywords").agg(F.count(F.lit(1)).alias("n_rules"))


def _in_windows(texts: DataFrame, index: DataFrame, keys: list[str], text: str, grams: list[int], longest: int) -> DataFrame:
    """``keys, word`` for every ``word`` of the index in a lower-case text, by the windows of the text."""

    def windows(c: Column) -> Column:
        at = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c)))
        return F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(longest))))

    seen = texts.select(*keys, F.explode(windows(F.col(text))).alias("window"))
    starts = F.array_distinct(F.array(*[F.substring("window", 1, n) for n in sorted(grams)]))
    unfolded = seen.withColumn("gram", F.explode(starts))
    return unfolded.join(index, "gram").filter(F.startswith("window", "word")).select(*keys, "word")


def matched_words(texts: DataFrame, words: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, word`` for every ``word`` that a text contains, in any case; each pair once."""
    index = words.select("word").distinct().withColumns({"gram": F.substring("word", 1, GRAM), "spaced": F.contains("word", F.lit(" "))})
    # Two rows: as many lengths as GRAM, and one number.
    kinds = index.groupBy("spaced").agg(F.collect_set(F.length("gram")).alias("of"), F.max(F.length("word")).alias("longest")).collect()
    met = texts.select(*keys).limit(0).withColumn("word", F.lit(""))
    lower = texts.select(*keys, F.lower(text).alias("_lower"))
    for kind in kinds:
        own = index.filter(F.col("spaced") == kind.spaced).select("word", "gram")
        if kind.spaced:
            found = _in_windows(lower, own, keys, "_lower", kind.of, kind.longest)
        else:
            pieces = lower.select(*keys, F.explode(F.array_distinct(F.split("_lower", " "))).alias("_piece"))
            found = _in_windows(pieces.select("_piece").distinct(), own, ["_piece"], "_piece", kind.of, kind.longest).distinct()
            found = pieces.join(found, "_piece").select(*keys, "word")
        met = met.unionByName(found)
    return met.distinct()


def match_keywords(texts: DataFrame, rules: DataFrame, keys: list[str], text: str = "text", rule: str = "rule_id", words: str = "keywords") -> DataFrame:
    """``keys, rule`` for every rule with a keyword that occurs in the text: ``matches_any`` for all rules at once."""
    postings = keywords(rules, rule, words)
    return matched_words(texts, postings, keys, text).join(postings, "word").select(*keys, F.col("rule").alias(rule)).distinct()


def url_key(url: Column) -> Column:
    """A url as its prefixes are compared: host in lower case, without scheme, query, fragment and closing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, rest = F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), F.regexp_extract(bare, r"^[^/]*(.*)$", 1)
    return F.nullif(F.regexp_replace(F.concat(host, rest), r"/+$", ""), F.lit(""))


def url_prefixes(url: Column) -> Column:
    """All prefixes of a url's key that end where a path segment does, the whole key included."""
    parts = F.split(url_key(url), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def bind_by_prefix(snapshots: DataFrame, rules: DataFrame, keys: list[str], rule: str = "rule_id") -> DataFrame:
    """For every snapshot the rule with the longest url prefix, or the reason why none reads it.

    ``snapshots`` need ``requested_url, final_url, fetch_mode`` beside ``keys``; pass facts, bodies are not used. ``rules`` have
    ``url_prefix`` and ``fetch_mode``, NULL for any mode. Both the requested and the final url count; the requested one wins
    among equally long prefixes, then the rule that names the mode, then the smaller rule. Columns: ``keys``, ``rule``,
    ``url_prefix`` and ``reason`` (``no url``, ``no rule for the url``, ``other mode``), NULL where a rule is bound.
    """
    index = rules.select(
        F.col(rule).alias("_rule"), url_key(F.col("url_prefix")).alias("_prefix"), F.col("url_prefix").alias("_told"),
        F.col("fetch_mode").alias("_mode"),
    )
    # Of the rules of one prefix and mode only the smallest can win: a prefix that very many rules name is met once per mode.
    smallest = F.min(F.struct("_rule", "_told")).alias("_of")
    index = index.filter("_rule IS NOT NULL AND _prefix IS NOT NULL").groupBy("_prefix", "_mode").agg(smallest).select("_prefix", "_mode", "_of.*")

    def of(url: str, second: bool) -> Column:
        return F.transform(F.coalesce(url_prefixes(F.col(url)), F.array().cast("array<string>")), lambda p: F.struct(p.alias("p"), F.lit(second).alias("second")))

    found = snapshots.withColumn("_of", F.concat(of("requested_url", False), of("final_url", True)))
    asked = found.select(*keys, "fetch_mode", F.explode_outer("_of").alias("_at"), (F.size("_of") == 0).alias("_bare"))
    met = asked.join(index, F.col("_at.p") == F.col("_prefix"), "left")
    fits = F.col("_rule").isNotNull() & (F.col("_mode").isNull() | F.col("_mode").eqNullSafe(F.col("fetch_mode")))
    rank = F.struct(~fits, -F.length("_prefix"), F.col("_at.second"), F.col("_mode").isNull(), F.col("_rule"))
    best = F.min_by(F.struct(fits.alias("fits"), "_rule", "_told"), rank).alias("_best")
    every = met.groupBy(*keys).agg(best, F.bool_or(F.col("_rule").isNotNull()).alias("_any"), F.bool_and("_bare").alias("_none"))
    bound = F.col("_best.fits")
    return every.select(
        *keys,
        F.when(bound, F.col("_best._rule")).alias(rule),
        F.when(bound, F.col("_best._told")).alias("url_prefix"),
        F.when(bound, None).when(F.col("_none"), "no url").when(F.col("_any"), "other mode").otherwise("no rule for the url").alias("reason"),
    )
