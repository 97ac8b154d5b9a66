"""The sources: registry and extraction rules as tables.

A new source is a registry row and one or more rule rows; no code. Several rules of one source are
its channels (lower rank first). A rule with ``follow`` picks a link on a listing page, and a rule
of unit ``article`` reads the page behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventboard.operators.outline import PAGE, SELECTOR, selector
from eventboard.schemas import REGISTRY

TIER = "struct<tier:int,part:string,form:string,guarded:boolean>"
RULES = (
    "source_id string, event_type string, title string, channel int, unit string, url string, fetch_mode string,"
    f" cards array<{SELECTOR}>, closest array<{SELECTOR}>, drop_noscript boolean, first_n int,"
    " keywords array<string>, keyword_in string, version_ok boolean, href_pattern string,"
    " follow boolean, on_missing string, listing_url string, forbidden_query string, listing_status boolean,"
    " unguarded boolean, headings array<string>, text_headings array<string>, title_all boolean, title_else string, fixed_title string,"
    f" tiers array<{TIER}>, policy string, confidence string, notes_prefix string, public_url string,"
    " link_base string, cut_query boolean, link_as_is boolean, failure_text string, no_link_text string,"
    " source_tz string, source_label string, slot_dow int, slot_time string, slot_note string"
)

# The registered sources in their order.
SOURCES = [
    ("fortnite", "next-season", "Fortnite"),
    ("lol", "next-patch", "League of Legends"),
    ("valorant", "last-patch", "VALORANT"),
    ("cs2", "last-update", "Counter-Strike 2"),
    ("minecraft", "last-release", "Minecraft"),
    ("roblox", "status", "Roblox"),
    ("gta", "weekly-reset", "GTA Online"),
    ("warzone", "last-patch", "Warzone"),
    ("genshin", "next-banner", "Genshin Impact"),
    ("pubg", "last-patch", "PUBG"),
    ("red-dead-redemption-2", "last-update", "Red Dead Redemption 2"),
    ("ea-sports-fc", "last-title-update", "EA SPORTS FC"),
]
TITLES = {
    "fortnite": "Fortnite Season End",
    "lol": "League of Legends Next Patch",
    "valorant": "VALORANT Last Patch",
    "cs2": "Counter-Strike 2 Last Update",
    "minecraft": "Minecraft Last Release",
    "roblox": "Roblox Service Status",
    "gta": "GTA Online Weekly Reset",
    "warzone": "Call of Duty Warzone Last Patch",
    "genshin": "Genshin Impact Next Banner End",
    "pubg": "PUBG Last Patch",
    "red-dead-redemption-2": "Red Dead Redemption 2 Last Update",
    "ea-sports-fc": "EA SPORTS FC Last Title Update",
}
URLS = {
    "fortnite": "https://www.fortnite.com/battle-pass",
    "lol": "https://support-leagueoflegends.riotgames.com/hc/en-us/articles/360018987893-League-of-Legends-Patch-Schedule",
    "valorant": "https://playvalorant.com/en-us/news/game-updates/",
    "cs2": "https://www.counter-strike.net/news/updates",
    "cs2-feed": "https://store.steampowered.com/feeds/news/app/730/?l=english",
    "minecraft": "https://feedback.minecraft.net/hc/en-us/sections/360001186971-Release-Changelogs",
    "roblox": "http://hostedstatus.com/1.0/status/59db90dbcdeb2f04dadcf16d",
    "roblox-public": "https://status.roblox.com",
    "gta": "https://www.rockstargames.com/gta-online",
    "warzone": "https://www.callofduty.com/patchnotes",
    "genshin": "https://genshin.hoyoverse.com/en/news",
    "pubg": "https://pubg.com/en/news?category=patch_notes",
    "red-dead-redemption-2": "https://www.rockstargames.com/newswire",
    "ea-sports-fc": "https://forums.ea.com/category/ea-sports-fc-en/blog/ea-sports-fc-game-info-hub-en",
}
# What a good page without a date is reported as; ``{url}`` is the page.
FAILURES = {
    "fortnite": "the page names no season end",
    "lol": "no upcoming patch in the schedule at {url}",
    "valorant": "no dated patch article in the list",
    "cs2": "no dated post on the updates page",
    "cs2-feed": "the feed is not a list of items",
    "minecraft": "no release date at {url}",
    "roblox": "the status document has no update time",
    "warzone": "no dated patch notes in the list",
    "genshin": "no banner end at {url}",
    "pubg": "no patch date at {url}",
    "red-dead-redemption-2": "no dated article about the game in the list",
    "ea-sports-fc": "no dated title update in the hub",
}
NO_LINK = "the list has no link to an article"
BODY_TITLE = "Counter-Strike 2 Update"
SEASON_LABEL = "Fortnite Battle Pass (Official)"


def registry(spark: SparkSession, sources: list[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = [(*source, i) for i, source in enumerate(sources or SOURCES)]
    return spark.createDataFrame(rows, REGISTRY)


def rule(
    source_id: str,
    event_type: str,
    unit: str,
    tiers: list[tuple[str, str, bool]],
    *,
    title: str | None = None,
    channel: int = 1,
    url: str | None = None,
    cards: list[str] | None = None,
    closest: list[str] | None = None,
    policy: str = "first",
    confidence: str = "high",
    **rest,
) -> dict:
    """One rule row. ``tiers`` are (part, form, guarded) in priority order; see ``observe`` for both."""
    row = dict.fromkeys(part.split()[0] for part in _top_level(RULES))
    row.update(
        source_id=source_id,
        event_type=event_type,
        unit=unit,
        title=title or TITLES.get(source_id, source_id),
        channel=channel,
        url=url,
        cards=[selector(c) for c in cards] if cards else None,
        closest=[selector(c) for c in closest] if closest else None,
        tiers=[dict(tier=i, part=p, form=f, guarded=g) for i, (p, f, g) in enumerate(tiers, start=1)],
        policy=policy,
        confidence=confidence,
        drop_noscript=False,
        version_ok=False,
        follow=False,
        listing_status=False,
        unguarded=False,
        title_all=False,
        cut_query=False,
        link_as_is=False,
    )
    unknown = set(rest) - set(row)
    if unknown:
        raise ValueError(f"unknown rule fields: {sorted(unknown)}")
    row.update(rest)
    return row


def _top_level(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, char in enumerate(ddl):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


# Where each source shows its date and which words mark a relevant item.
def default_rules() -> list[dict]:
    kind = {source: event_type for source, event_type, _ in SOURCES}

    def of(source: str, unit: str, tiers, **rest) -> dict:
        rest.setdefault("url", None if unit == "article" else URLS.get(source))
        rest.setdefault("failure_text", FAILURES.get(source))
        if unit == "article":
            rest.setdefault("listing_url", URLS.get(source))
        return rule(source, kind[source], unit, tiers, **rest)

    newswire = dict(
        cards=["a@/newswire/article/"], keywords=["red dead", "rdr2"], keyword_in="text",
        headings=["h3", "h4", "*title"], title_all=True, title_else="line", link_base="https://www.rockstargames.com",
    )
    newswire_tiers = [("marks", "any_date", False), ("text", "month_comma", False)]
    changelog_cards = [
        ".article-list-item", ".article-list-link", ".article-list a", "article", ".blocks-item", "a@/articles/",
    ]
    changelog = dict(
        cards=changelog_cards, drop_noscript=True, keywords=["changelog", "patch", "release"], version_ok=True,
        keyword_in="link", follow=True, on_missing="use_listing",
    )
    news = dict(
        cards=["a"], closest=["article", ".news-item", ".card", "div"], href_pattern=r"/en/news/\d+", follow=True,
        on_missing="fail", cut_query=True, forbidden_query="category=patch_notes", link_base="https://pubg.com",
        no_link_text=NO_LINK,
    )
    return [
        of("fortnite", "page", [("page_text", "ends_on", False)], source_label=SEASON_LABEL),
        of("lol", "row", [("cell", "month_loose", True)], policy="next", notes_prefix="Patch "),
        of(
            "valorant", "card", [("time_attr", "any_date", False), ("text", "iso_or_month", False)],
            cards=["article", ".article-card", "a@patch-notes"], policy="latest", confidence="medium",
            headings=["h2", "h3", ".title"], public_url=URLS["valorant"],
        ),
        of(
            "cs2", "card", [("marks_date", "any_date", False), ("body", "month_comma", False)],
            cards=[".blog_post", ".release_notes_post", "a@/news/entry/", PAGE], headings=[".title"], title_all=True,
            title_else="chars", fixed_title=BODY_TITLE, link_as_is=True, fetch_mode="browser",
        ),
        of(
            "cs2", "feed", [("feed", "rfc822", False)], channel=2, url=URLS["cs2-feed"],
            failure_text=FAILURES["cs2-feed"], keywords=["update", "patch", "release notes"],
        ),
        of("minecraft", "card", [], fetch_mode="http", **changelog),
        of("minecraft", "card", [], fetch_mode="browser", channel=2, unguarded=True, **changelog),
        of(
            "minecraft", "article",
            [("time_any", "any_date", True), ("jsonld", "any_date", False), ("text", "month_abbrev", False)],
            cards=[PAGE], drop_noscript=True, headings=["h1", "h2", ".article-title", ".title"], on_missing="use_listing",
        ),
        of("roblox", "status", [("status", "status", False)], public_url=URLS["roblox-public"], notes_prefix="Current status: "),
        of(
            "gta", "weekly", [("weekly", "weekly", False)], slot_dow=4, slot_time="10:00",
            slot_note="new week every Thursday, 10:00 UTC",
        ),
        of(
            "warzone", "card", [("time_attr", "any_date", False), ("text", "slash_or_month", False)],
            cards=["article", ".patch-note", ".card", "a"], keywords=["warzone"], keyword_in="text", policy="latest",
            confidence="medium", headings=["h2", "h3", ".title"], text_headings=["h2", "h3"], public_url=URLS["warzone"],
        ),
        of(
            "genshin", "card", [], drop_noscript=True, follow=True, on_missing="fail", confidence="medium",
            cards=[".news__list .news__item", "article", ".news-item", ".news-list li"], keyword_in="text",
            keywords=["event wish", "banner", "available", "time:", "patch", "update", "version"],
            headings=["h3", ".title"], title_all=True, listing_status=True,
        ),
        of(
            "genshin", "article", [("main_text", "end_time", False)], drop_noscript=True, confidence="medium",
            cards=["article", ".article-body", "main", "#main-content", PAGE],
        ),
        of("pubg", "card", [], fetch_mode="http", **news),
        of("pubg", "card", [], channel=2, fetch_mode="browser", **news),
        of(
            "pubg", "article",
            [
                ("time_header", "published", True), ("listing_date", "dotted_date", False),
                ("text", "month_name_comma", False), ("jsonld", "any_date", False), ("text", "month_name", False),
            ],
            cards=[PAGE], drop_noscript=True, headings=["h1", "h2", ".article-title", ".title"],
        ),
        of("red-dead-redemption-2", "card", newswire_tiers, fetch_mode="http", confidence="medium", **newswire),
        of("red-dead-redemption-2", "card", newswire_tiers, fetch_mode="browser", channel=2, **newswire),
        of(
            "ea-sports-fc", "card",
            [("context", "month_comma", False), ("card_marks", "any_date", False), ("context_ago", "relative", False)],
            cards=["a"], closest=["li", "div*entry", "div*row"], confidence="medium", keyword_in="text",
            keywords=["title update", "patch notes", "update notes", "version"], link_base="https://forums.ea.com",
        ),
    ]


def rules_table(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else default_rules(), RULES)


def register(rules: DataFrame, sources: DataFrame, rows: list[dict], name: str) -> tuple[DataFrame, DataFrame]:
    """Rules and registry with one more source."""
    spark = rules.sparkSession
    first = rows[0]
    entry = spark.createDataFrame([(first["source_id"], first["event_type"], name, None)], REGISTRY)
    return rules.unionByName(rules_table(spark, rows)), sources.unionByName(entry)
