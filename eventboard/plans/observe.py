"""Snapshots and rules to observations, in two phases: listings first, then the chosen articles only.

Everything that needs a page's body happens inside its row: elements, candidate values, dates and
the pick are array expressions, so the wide body never enters a shuffle and a source with very many
pages is just more rows. What leaves a page is one narrow record.

1. Listings and pages that show their date themselves are read. The plan is built for the units, parts and
   forms that the rules at hand use, nothing else. Without a rule that follows links this is all.
2. Each (run, source) chooses one article from facts without bodies: the first channel whose link (or, where
   the rule allows it, whose own page) was loaded. Bloom filters over the chosen urls and snapshots prune the
   scan, so the parser sees one article per (run, source), and bodies of all others are not even looked at.

A chosen article that shows no date is a failure; links of later channels are not tried instead.

Parts a tier can read
    cell, page_text, feed, status                     whole documents
    text, time_attr, marks, marks_date, context,
    card_marks, context_ago, body                     cards of a listing
    time_any, time_header, text, main_text, jsonld,
    listing_date                                      article pages
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.functions import dates as dt
from eventboard.functions import predicates as pr
from eventboard.functions import text as tx
from eventboard.operators import outline
from eventboard.operators import pages as pg
from eventboard.operators.bloom import bloom_filter, may_contain
from eventboard.operators.resolve import CRASHED
from eventboard.operators.sizing import broadcast_if_small
from eventboard.schemas import OBSERVATIONS, columns
from eventboard.session import stored
from eventboard.sources.feeds import items_of, status_of

CANDIDATE = (
    "array<struct<late:boolean,pos:int,tier:int,form:string,guarded:boolean,value:string,title:string,"
    "url:string,at:timestamp_ntz>>"
)
RUN_KEY = ["run_id", "source_id", "event_type"]
# Classes whose elements count as publication marks of an article.
MARK_CLASSES = ["date", "published-at", "article-date"]


@dataclass(frozen=True)
class Kinds:
    """What the rules at hand use; nothing else is built into the plan."""

    units: frozenset[str]
    parts: frozenset[str]
    forms: frozenset[str]
    policies: frozenset[str]
    follow: bool
    unguarded: bool

    @classmethod
    def of(cls, rules: DataFrame) -> Kinds:
        rows = (
            rules.select("unit", "policy", "follow", "unguarded", F.explode_outer("tiers").alias("t"))
            .select("unit", "policy", "follow", "unguarded", "t.part", "t.form")
            .distinct()
            .collect()  # as many as there are kinds of rules
        )
        sets = [frozenset(r[c] for r in rows if r[c] is not None) for c in ("unit", "part", "form", "policy")]
        return cls(*sets, follow=any(r.follow for r in rows), unguarded=any(r.unguarded for r in rows))


def _cases(name: Column, choices: dict[str, Column], used: frozenset[str]) -> Column | None:
    """Value by name, for the names in use."""
    wanted = [(n, v) for n, v in choices.items() if n in used]
    if not wanted:
        return None
    return reduce(lambda out, nv: out.when(name == nv[0], nv[1]), wanted[1:], F.when(name == wanted[0][0], wanted[0][1]))


def bind_rules(snapshots: DataFrame, rules: DataFrame) -> DataFrame:
    """Snapshots with each rule that reads them.

    A rules table of checked size is broadcast, so bodies stay where they were read; a larger one is
    joined by shuffle on the source, where adaptive skew joins split a hot source.
    """
    r = rules.withColumnsRenamed({"source_id": "_source", "fetch_mode": "_mode"})
    # Selectors travel to the parser as text, prepared once per rule rather than once per page.
    r = r.withColumns({"cards": F.to_json("cards"), "closest": F.to_json("closest")})
    r = broadcast_if_small(r)
    article = F.col("unit") == "article"
    its_page = F.when(
        article, (F.col("requested_url") != F.col("listing_url")) | F.coalesce(F.col("on_missing") == "use_listing", F.lit(False))
    ).otherwise(F.col("url").isNull() | (F.col("requested_url") == F.col("url")))
    its_mode = F.col("_mode").isNull() | (F.col("_mode") == F.col("fetch_mode"))
    return snapshots.join(r, (F.col("source_id") == F.col("_source")) & its_page & its_mode).drop("_source", "_mode")


def _joined(texts: Column) -> Column:
    return F.nullif(F.array_join(texts, ""), F.lit(""))


def _texts(marks: Column, wanted) -> Column:
    return _joined(F.transform(F.filter(marks, wanted), lambda m: m["text"]))


def _is_time(m: Column) -> Column:
    return m["tag"] == "time"


def _is_datelike(m: Column) -> Column:
    return F.exists(m["classes"], lambda c: F.contains(c, F.lit("date")))


def _is_date(m: Column) -> Column:
    return F.array_contains(m["classes"], "date")


def _marks_text(marks: Column) -> Column:
    return F.coalesce(_texts(marks, _is_time), _texts(marks, _is_datelike))


def _heading_matches(h: Column, wanted: Column) -> Column:
    def one(s: Column) -> Column:
        name = F.substr(s, F.lit(2))
        return (
            F.when(s.startswith("."), F.array_contains(h["classes"], name))
            .when(s.startswith("*"), F.exists(h["classes"], lambda c: F.contains(c, name)))
            .otherwise(h["tag"] == s)
        )

    return F.exists(wanted, one)


def _title(e: Column, wanted: str = "headings") -> Column:
    heads = F.transform(F.filter(e["headings"], lambda h: _heading_matches(h, F.col(wanted))), lambda h: h["text"])
    title = tx.blank_to_null(F.when(F.col("title_all"), F.array_join(heads, "")).otherwise(F.get(heads, 0)))
    spare = F.when(F.col("title_else") == "line", tx.first_line(e["text"])).when(
        F.col("title_else") == "chars", tx.first_chars(e["text"])
    )
    own = F.when(F.col("headings").isNull() & (F.col("unit") == "card"), tx.strip(e["text"]))
    return F.coalesce(title, spare, own)


def _link(e: Column) -> Column:
    base = F.coalesce("link_base", "page_url")
    resolved = tx.resolve_url(e["href"], base)
    cut = F.when(F.col("cut_query"), F.split_part(resolved, F.lit("?"), F.lit(1))).otherwise(resolved)
    return F.when(F.col("link_as_is"), F.nullif(e["href"], F.lit(""))).otherwise(cut)


def _has_link(e: Column) -> Column:
    href = F.trim(e["href"])
    return href.isNotNull() & (href != "") & ~href.startswith("#")


def _relevant(e: Column) -> Column:
    text = F.when(F.col("keyword_in") == "link", e["link_text"]).otherwise(e["text"])
    words = F.col("keywords")
    wordy = words.isNull() | pr.matches_any(text, words) | (F.col("version_ok") & text.rlike(pr.VERSION_NUMBER))
    shaped = F.col("href_pattern").isNull() | F.coalesce(F.rlike(e["href"], F.col("href_pattern")), F.lit(False))
    return (e["tag"] == outline.PAGE) | (wordy & shaped)


def _cards() -> Column:
    kept = F.filter("elements", lambda e: e["kept"])
    first = F.when(F.col("first_n").isNull(), kept).otherwise(F.slice(kept, F.lit(1), F.coalesce("first_n", F.lit(1))))
    return F.filter(first, _relevant)


def _card_value(e: Column, part: Column, kinds: Kinds) -> Column:
    context = pg.context_text(F.col("elements"), e)
    undated = ~context.rlike(dt.MONTH_COMMA)
    card = F.get(F.col("elements"), e["card_at"])
    choices = {
        "text": e["text"],
        "body": e["text"],
        "time_attr": F.get(F.filter(e["times"], _is_time), 0)["datetime"],
        "marks": _marks_text(e["times"]),
        "marks_date": F.coalesce(_texts(e["times"], _is_date), _texts(e["times"], _is_time)),
        "context": context,
        "card_marks": F.when(undated, _marks_text(card["times"])),
        "context_ago": F.when(undated, context),
    }
    value = _cases(part, choices, kinds.parts)
    return value if value is not None else _text()


def _candidate(late, pos, t: Column, value, title, url, at=None) -> Column:
    return F.struct(
        late.alias("late"),
        pos.cast("int").alias("pos"),
        t["tier"].alias("tier"),
        t["form"].alias("form"),
        t["guarded"].alias("guarded"),
        value.alias("value"),
        title.alias("title"),
        url.alias("url"),
        (at if at is not None else F.lit(None).cast("timestamp_ntz")).alias("at"),
    )


def _text(c: Column | None = None) -> Column:
    return (c if c is not None else F.lit(None)).cast("string")


def _card_candidates(kinds: Kinds) -> Column:
    def of_card(e: Column, i: Column) -> Column:
        whole = e["tag"] == outline.PAGE
        tiers = F.filter("tiers", lambda t: (t["part"] == "body") == whole)
        title = F.when(whole, F.col("fixed_title")).otherwise(_title(e))
        url = F.when(~whole, _link(e))
        # Some rules title a date found in plain text by fewer kinds of heading.
        plain = F.when(F.col("text_headings").isNull(), title).otherwise(_title(e, "text_headings"))

        def one(t: Column) -> Column:
            named = F.when(t["part"] == "text", plain).otherwise(title)
            return _candidate(whole, i, t, _card_value(e, t["part"], kinds), named, url)

        return F.transform(tiers, one)

    return F.flatten(F.transform("hits", of_card))


def _row_candidates() -> Column:
    rows = F.filter(pg.table_cells(F.col("body")), lambda r: (F.get(r, 0) != "") & (F.get(r, 1) != ""))
    tier = F.get("tiers", F.lit(0))
    return F.transform(rows, lambda r, i: _candidate(F.lit(False), i, tier, F.get(r, 1), F.get(r, 0), _text()))


def _page_candidates() -> Column:
    tier = F.get("tiers", F.lit(0))
    return F.array(
        _candidate(F.lit(False), F.lit(0), tier, tx.page_text(F.col("body"), F.col("fetch_mode")), _text(), _text())
    )


def _feed_candidates() -> Column:
    items = items_of(F.col("body"))
    match = F.filter(items, lambda i: pr.matches_any(i["title"], F.col("keywords")))
    item = F.coalesce(F.get(match, 0), F.get(items, 0))
    tier = F.get("tiers", F.lit(0))
    one = _candidate(F.lit(False), F.lit(0), tier, item["pubDate"], item["title"], item["link"])
    # A feed is a list of items; a document with a single one is no feed.
    return F.when(F.size(items) > 1, F.array(one))


def _status_candidates() -> Column:
    word, at = status_of(F.col("body"))
    tier = F.get("tiers", F.lit(0))
    return F.array(_candidate(F.lit(False), F.lit(0), tier, _text(), word, _text(), at))


def _mark_value(m: Column, content: bool = True) -> Column:
    choices = [m["datetime"], *([m["content"]] if content else []), tx.strip(m["text"]), *([m["title"]] if content else [])]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def _is_published(m: Column) -> Column:
    return _is_time(m) | (m["tag"] == "meta") | F.exists(m["classes"], lambda c: c.isin(MARK_CLASSES))


def _has_class(name: str):
    return lambda m: F.array_contains(m["classes"], name)


def _ordered_mark(marks: Column) -> Column:
    """The first time element, else the first of each class in turn: how a rendered page is asked."""
    first = [F.get(F.filter(marks, wanted), 0) for wanted in (_is_time, _has_class("date"), _has_class("article-date"))]
    return F.coalesce(*[F.nullif(c, F.lit("")) for m in first for c in (m["datetime"], m["title"], tx.strip(m["text"]))])


def _article_candidates(kinds: Kinds) -> Column:
    page = F.get(F.filter("elements", lambda e: e["tag"] == outline.PAGE), 0)
    marks = F.filter(page["times"], _is_published)
    anywhere = _mark_value(F.get(marks, 0))
    in_header = _mark_value(F.get(F.filter(marks, lambda m: m["header"] & (m["tag"] != "meta")), 0), content=False)
    main = _joined(F.transform(F.filter("elements", lambda e: e["tag"] != outline.PAGE), lambda e: e["text"]))
    values = {
        "time_any": anywhere,
        "time_header": F.coalesce(in_header, anywhere),
        "text": page["text"],
        "main_text": F.coalesce(main, page["text"]),
    }
    title = _title(page)

    def one(late: bool):
        def of(t: Column) -> Column:
            value = _ordered_mark(page["times"]) if late else _cases(t["part"], values, kinds.parts)
            at = F.when(t["part"] == "jsonld", pg.jsonld_date(F.col("body"))) if "jsonld" in kinds.parts and not late else None
            named = F.when(t["tier"] == 1, title)
            return _candidate(F.lit(late), F.lit(0), t, value if value is not None else _text(), named, _text(), at)

        return of

    found = F.transform(F.filter("tiers", lambda t: t["part"] != "listing_date"), one(False))
    if not kinds.unguarded or "time_any" not in kinds.parts:
        return found
    # Rendered listings ask their article's marks in another order.
    return F.concat(found, F.transform(F.filter("tiers", lambda t: t["part"] == "time_any"), one(True)))


_PATTERNS = {
    **{form: pattern for form, (pattern, _) in dt.FORMS.items()},
    "iso_or_month": f"{dt.ISO_DATE}|{dt.MONTH_LOOSE}",
    "slash_or_month": f"{dt.SLASH_DATE}|{dt.MONTH_LOOSE}",
    "relative": dt.RELATIVE,
}


#: Forms whose match is read by one reading in the rule's zone; the others may turn out to be any date.
_WORDED_OR_NUMERIC = {
    **{f: dt.FORMS[f][1] for f in ("month_comma", "month_loose", "month_name_comma", "month_name", "month_abbrev", "dotted_date", "slash_date")},
    "slash_or_month": dt.slash_or_month,
}


def _match(value: Column, form: Column, anchor: Column, kinds: Kinds) -> Column:
    """The short piece of ``value`` that its form reads, so long texts are searched only once."""
    # End times keep one hit per pattern; in this order no hit hides another pattern's hit.
    hits = [F.nullif(F.regexp_extract(value, dt.END_TIMES[i], 0), F.lit("")) for i in (3, 1, 0, 2)]
    choices = {
        "end_time": F.concat_ws("\n", *hits),
        **{name: F.regexp_extract(value, pattern, 0) for name, pattern in _PATTERNS.items()},
        "ends_on": F.regexp_extract(value, dt.ENDS_ON, 0),
        "published": dt.yearless(dt.strip_noise_prefix(value), anchor),
    }
    out = _cases(form, choices, kinds.forms)
    return out.otherwise(value) if out is not None else value


def _read(match: Column, form: Column, anchor: Column, tz: Column, kinds: Kinds) -> Column:
    """The instant a match stands for."""
    choices = {
        "relative": dt.relative(match, anchor),
        "end_time": dt.end_time(match, anchor),
        "ends_on": dt.ends_on(match),
        **{form: dt.at_zone(read(match), tz) for form, read in _WORDED_OR_NUMERIC.items()},
    }
    out = _cases(form, choices, kinds.forms)
    if not kinds.forms - set(choices) - {"status"}:
        return out if out is not None else F.lit(None).cast("timestamp_ntz")
    rest = dt.any_date(match, tz)
    return out.otherwise(rest) if out is not None else rest


def _best(found: Column, order, smallest: bool = True) -> Column:
    """The candidate with the smallest (largest) order key; arrays of structs compare field by field."""
    keyed = F.transform(found, lambda c: F.struct(*order(c), c.alias("c")))
    return (F.array_min(keyed) if smallest else F.array_max(keyed))["c"]


def with_pick(df: DataFrame, kinds: Kinds) -> DataFrame:
    """Add ``picked``, the candidate of ``held`` that the rule's policy prefers."""
    now = F.col("fetched_at")
    first = _best(F.col("held"), lambda c: [c["late"].alias("a"), c["pos"].alias("b"), c["tier"].alias("d")])
    staged = df.withColumn("_first", first)
    picked = F.col("_first")
    if "latest" in kinds.policies:
        timed = F.filter("held", lambda c: c["tier"] == 1)
        newest = _best(timed, lambda c: [c["at"].alias("a"), (-c["pos"]).alias("b")], smallest=False)
        staged = staged.withColumn("_newest", newest)
        # A text date only counts while nothing is held, that is when it is the page's first date.
        use_first = F.col("_newest").isNull() | (F.col("_first.at") >= F.col("_newest.at"))
        picked = F.when((F.col("policy") == "latest") & ~use_first, F.col("_newest")).otherwise(picked)
    if "next" in kinds.policies:
        ahead = F.filter("held", lambda c: pr.upcoming(c["at"], now, "day"))
        staged = staged.withColumn("_next", _best(ahead, lambda c: [c["at"].alias("a"), c["pos"].alias("b")]))
        picked = F.when(F.col("policy") == "next", F.col("_next")).otherwise(picked)
    return staged.withColumn("picked", picked).drop("_first", "_next", "_newest", "held")


def _page(snapshots: DataFrame, rules: DataFrame, outlined: Column | None) -> DataFrame:
    bound = bind_rules(snapshots, rules).withColumn("page_url", pr.final_url(F.col("final_url"), F.col("requested_url")))
    if outlined is None:
        return bound
    body = F.when(pr.fetch_ok(F.col("http_status")) & outlined, F.col("body"))
    return bound.withColumn("elements", outline.elements(body, F.col("cards"), F.col("closest"), F.col("drop_noscript")))


def _found(pages: DataFrame, raw: Column, kinds: Kinds) -> DataFrame:
    """Pages with their dated candidates as ``found``, without body and elements."""
    matched = pages.withColumn("raw", raw).drop("body", "elements", "hits", "chosen", "cards", "closest")
    matched = matched.withColumn(
        "raw", F.transform("raw", lambda c: c.withField("value", _match(c["value"], c["form"], F.col("fetched_at"), kinds)))
    )
    read = F.transform(
        "raw",
        lambda c: c.withField(
            "at", F.coalesce(c["at"], _read(c["value"], c["form"], F.col("fetched_at"), F.col("source_tz"), kinds))
        ),
    )
    found = F.filter(read, lambda c: c["at"].isNotNull())
    return matched.withColumn("found", F.coalesce(found, F.array().cast(CANDIDATE))).drop("raw")


def read_pages(snapshots: DataFrame, rules: DataFrame, kinds: Kinds | None = None) -> DataFrame:
    """One narrow row per (snapshot, rule that is not about articles): the pick, or the link to follow."""
    kinds = kinds or Kinds.of(rules)
    rules = rules.filter(~F.col("unit").isin("article", "weekly"))
    unit, ok = F.col("unit"), pr.fetch_ok(F.col("http_status"))
    cards = "card" in kinds.units
    pages = _page(snapshots, rules, unit == "card" if cards else None)
    choices = {
        "row": _row_candidates, "page": _page_candidates, "feed": _feed_candidates, "status": _status_candidates,
    }
    candidates = {name: make() for name, make in choices.items() if name in kinds.units}
    link = F.lit(None).cast("struct<url:string,title:string,listed_at:timestamp_ntz>")
    follow = F.lit(False)
    if cards:
        pages = pages.withColumn("hits", F.when(unit == "card", _cards()))
        candidates = {"card": _card_candidates(kinds), **candidates}
    if kinds.follow:
        follow = (unit == "card") & F.col("follow")
        pages = pages.withColumn("chosen", F.when(follow, F.get(F.filter("hits", _has_link), 0)))
        card = F.get(F.col("elements"), F.col("chosen.card_at"))
        link = F.when(
            F.col("chosen").isNotNull(),
            F.struct(
                _link(F.col("chosen")).alias("url"),
                F.when(F.col("headings").isNotNull(), _title(F.col("chosen"))).alias("title"),
                dt.dotted_date(card["text"]).alias("listed_at"),
            ),
        )
    by_unit = _cases(unit, candidates, kinds.units)
    none = F.lit(None).cast(CANDIDATE)
    raw = F.when(~ok | follow, none).otherwise(by_unit) if by_unit is not None else none
    dated = _found(pages.withColumn("link", link), raw, kinds)
    held = F.filter("found", lambda c: ~c["guarded"] | pr.plausible(c["at"], F.col("fetched_at")))
    return with_pick(dated.withColumn("held", held), kinds)


def read_articles(snapshots: DataFrame, rules: DataFrame, kinds: Kinds) -> DataFrame:
    """One narrow row per (snapshot, rule about articles) with its dated candidates."""
    pages = _page(snapshots, rules.filter(F.col("unit") == "article"), F.lit(True))
    raw = F.when(pr.fetch_ok(F.col("http_status")), _article_candidates(kinds))
    return _found(pages, raw, kinds).select("snapshot_id", "source_id", "event_type", "found", "failure_text")


def _season_extras(picked: Column) -> Column:
    """Derived season fields of an ``ends_on`` pick, under their record names."""
    end = F.to_date(picked["at"])
    after = F.date_add(end, 1)
    pairs = {
        "currentSeasonEnds": end.cast("string"),
        "timezone": dt.ends_on_zone(picked["value"]),
        "nextSeasonStart": F.lit(None).cast("string"),
        "nextSeasonEstimate": after.cast("string"),
        "nextSeasonEstimateFriendly": dt.friendly(after),
        "sourceName": F.col("source_label"),
        "provider": F.col("source_id"),
    }
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return F.when(picked["form"] == "ends_on", F.create_map(*flat))


def _failure(ok_fetch: Column, error: Column, status: Column, text: Column, url: Column) -> Column:
    code = F.concat(F.lit("HTTP "), F.coalesce(status, F.lit(0)).cast("string"))
    load = F.coalesce(F.nullif(error, F.lit("")), code)
    message = F.replace(F.coalesce(text, F.lit("no date found")), F.lit("{url}"), F.coalesce(url, F.lit("")))
    return F.concat(F.lit(CRASHED), F.when(ok_fetch, message).otherwise(load))


_OUT = [*columns(OBSERVATIONS), "channel"]


def _ranked(rows: DataFrame, ok: Column, snapshot: Column) -> DataFrame:
    """Rows with their rank among those of a (run, source): the first good channel, else the last one tried."""
    channel = F.when(ok, F.col("channel")).otherwise(-F.col("channel"))
    return rows.withColumn("_rank", F.struct(~ok, channel, snapshot.cast("long").alias("at")))


def _direct(pages: DataFrame) -> DataFrame:
    """Observations of pages that show their date themselves, with ``_rank``."""
    p, loaded = F.col("picked"), pr.fetch_ok(F.col("http_status"))
    own = F.when(F.col("unit") == "feed", F.coalesce(F.nullif(p["url"], F.lit("")), "requested_url")).when(
        F.col("unit") == "card", F.nullif(p["url"], F.lit(""))
    )
    notes = F.concat(F.coalesce("notes_prefix", F.lit("")), F.nullif(p["title"], F.lit("")))
    at = F.when(loaded, p["at"])
    ok = at.isNotNull()
    failure = F.coalesce(pr.failure_type(F.col("http_status"), F.col("fetch_mode")), F.lit("parse_failed"))
    text = _failure(loaded, F.col("error"), F.col("http_status"), F.col("failure_text"), F.col("page_url"))
    rows = pages.select(
        *RUN_KEY, "channel", "title", ok.alias("ok"), at.alias("event_at"),
        F.when(ok, F.coalesce("public_url", own, "page_url")).alias("source_url"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        F.when(ok, F.nullif(notes, F.lit(""))).alias("notes"),
        "http_status", "fetch_mode",
        F.when(~ok, failure).alias("failure_type"), F.when(~ok, text).alias("explanation"),
        "fetched_at", F.when(ok, _season_extras(p)).alias("extras"), "snapshot_id",
    )
    return _ranked(rows, F.col("ok"), F.col("snapshot_id")).select(*_OUT, "_rank")


def choose_articles(listings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per (run, source): the listing that speaks for it (``l``) and the article it leads to (``a``).

    Listing rows come with their link and, if the rule allows, their own page as a second choice. Facts of the
    newest load of each url decide, bodies are not read: the first channel with a loaded article wins, and if
    none has one the last channel's failure is told.
    """
    guard = pr.not_listing(F.col("link.url"), F.col("requested_url"), F.col("page_url"), F.col("forbidden_query"))
    second = F.when(F.col("on_missing") == "use_listing", F.col("requested_url"))

    def to(choice: int, key: Column) -> Column:
        return F.struct(F.lit(choice).alias("choice"), key.alias("key"))

    first = to(1, F.when(guard, F.col("link.url")))
    choices = F.when(second.isNotNull(), F.array(first, to(2, second))).otherwise(F.array(first))
    listing = F.struct(
        "channel", "title", "confidence", "failure_text", "no_link_text", "unguarded", "listing_status", "http_status",
        "fetch_mode", "error", "fetched_at", "page_url", "link", "loaded", "choice", "snapshot_id",
    )
    asked = (
        listings.withColumn("loaded", pr.fetch_ok(F.col("http_status")))
        .withColumn("to", F.explode(choices))
        .select("*", "to.*")
        .select(*RUN_KEY, "key", listing.alias("l"))
    )
    url = ["run_id", "source_id", "requested_url"]
    wanted = bloom_filter(asked.filter(F.col("key").isNotNull()), ["run_id", "source_id", "key"])
    facts = may_contain(
        snapshots.select(*url, "snapshot_id", "fetched_at", "http_status", "fetch_mode", pr.final_url(F.col("final_url"), F.col("requested_url")).alias("page_url")),
        wanted, url,
    )
    fact = F.struct("snapshot_id", "http_status", "fetch_mode", "page_url", pr.fetch_ok(F.col("http_status")).alias("loaded"))
    order = F.struct(pr.fetch_ok(F.col("http_status")), "fetched_at", "snapshot_id")
    newest = facts.groupBy(*url).agg(F.max_by(fact, order).alias("a")).withColumnRenamed("requested_url", "key")
    met = asked.join(newest, ["run_id", "source_id", "key"], "left")
    missing = ~F.coalesce(F.col("a.loaded"), F.lit(False))
    channel = F.when(missing, -F.col("l.channel")).otherwise(F.col("l.channel"))
    best = F.min_by(F.struct("key", "l", "a"), F.struct(missing, channel, F.col("l.choice"), F.col("l.snapshot_id")))
    return met.groupBy(*RUN_KEY).agg(best.alias("best")).select(*RUN_KEY, "best.*")


def _followed(listings: DataFrame, snapshots: DataFrame, rules: DataFrame, kinds: Kinds) -> DataFrame:
    """Observations of sources that show their date behind a link: one row per (run, source), with ``_rank``."""
    chosen = stored(choose_articles(listings, snapshots), "chosen").withColumn("snapshot_id", F.col("a.snapshot_id"))
    wanted = bloom_filter(chosen.filter("a.loaded"), ["snapshot_id"])
    articles = read_articles(may_contain(snapshots, wanted), rules, kinds)
    met = chosen.join(articles.withColumnRenamed("failure_text", "article_text"), ["snapshot_id", "source_id", "event_type"], "left")
    return judge(met)


def judge(met: DataFrame) -> DataFrame:
    """Observations of listings with the article they chose (``key, l, a, found, article_text``)."""
    l, a = F.col("l"), F.col("a")
    has_link = l["link"].isNotNull() | (l["choice"] == 2)
    # Rendered listings trust their article's mark as it is, and ask for it in their own order.
    asked = F.exists("found", lambda c: c["late"]) & l["unguarded"]
    mine = F.filter("found", lambda c: F.when(c["tier"] == 1, c["late"] == F.coalesce(asked, F.lit(False))).otherwise(True))
    held = F.filter(mine, lambda c: ~c["guarded"] | l["unguarded"] | pr.plausible(c["at"], l["fetched_at"]))
    met = met.withColumn("best", _best(held, lambda c: [c["tier"].alias("t")]))
    best = F.col("best")
    # The listing's own date ranks right after the article's first tier.
    listed = l["link"]["listed_at"]
    found_at = F.when((best["tier"] == 1) | listed.isNull(), best["at"]).otherwise(listed)
    reached = F.coalesce(a["loaded"], F.lit(False))
    met = met.withColumn("at", F.when(l["loaded"] & reached, found_at))
    at = F.col("at")
    notes = F.coalesce(F.when(best["tier"] == 1, best["title"]), l["link"]["title"])
    failure = F.coalesce(
        pr.failure_type(l["http_status"], l["fetch_mode"]),
        F.when(~has_link, F.lit("parse_failed")),
        F.when(a.isNull(), F.lit("unavailable")),
        pr.failure_type(a["http_status"], a["fetch_mode"]),
        F.lit("parse_failed"),
    )
    lost = F.concat(
        F.lit("Article fetch failed: "), F.col("key"), F.lit(" ("),
        F.coalesce(a["http_status"], F.lit(0)).cast("string"), F.lit(")"),
    )
    text = (
        F.when(~has_link, F.coalesce(l["no_link_text"], l["failure_text"]))
        .when(~reached, lost)
        .otherwise(F.coalesce(l["failure_text"], F.col("article_text")))
    )
    missed = _failure(l["loaded"], l["error"], l["http_status"], text, F.coalesce(a["page_url"], l["page_url"]))
    # A good article speaks for itself, unless the rule reports the listing's own load.
    from_article = reached & ~l["listing_status"]
    ok = at.isNotNull()
    rows = met.select(
        *RUN_KEY,
        l["channel"].alias("channel"),
        l["title"].alias("title"),
        ok.alias("ok"),
        at.alias("event_at"),
        F.when(ok, a["page_url"]).alias("source_url"),
        F.when(ok, l["confidence"]).alias("confidence"),
        F.when(ok, F.nullif(notes, F.lit(""))).alias("notes"),
        F.when(from_article, a["http_status"]).otherwise(l["http_status"]).alias("http_status"),
        F.when(from_article, a["fetch_mode"]).otherwise(l["fetch_mode"]).alias("fetch_mode"),
        F.when(~ok, failure).alias("failure_type"),
        F.when(~ok, missed).alias("explanation"),
        l["fetched_at"].alias("fetched_at"),
        F.lit(None).cast("map<string,string>").alias("extras"),
        l["snapshot_id"].alias("snapshot_id"),
    )
    return _ranked(rows, F.col("ok"), F.col("snapshot_id")).select(*_OUT, "_rank")


def weekly_observations(runs: DataFrame, rules: DataFrame, boundary: str = "strict") -> DataFrame:
    """Computed sources: one observation per run (``run_id, started_at``) without any page.

    Weekday, time and note are the rule's own. Every run needs every computed source, so the result has as many
    rows as runs times rules of that kind; the rules are met as a table of checked size.
    """
    slots = ["slot_dow", "slot_time", "slot_note"]
    weekly = rules.filter(F.col("unit") == "weekly").select("source_id", "event_type", "title", "channel", "confidence", "url", *slots)
    many = runs.select("run_id", "started_at").join(broadcast_if_small(weekly))
    blank = {
        "ok": F.lit(True), "event_at": dt.next_weekly(F.col("started_at"), F.col("slot_dow"), F.col("slot_time"), boundary),
        "source_url": F.col("url"), "notes": F.col("slot_note"),
        "http_status": F.lit(None).cast("int"), "fetch_mode": _text(), "failure_type": _text(), "explanation": _text(),
        "fetched_at": F.col("started_at"), "extras": F.lit(None).cast("map<string,string>"),
    }
    return _ranked(many.select(*[blank[c].alias(c) if c in blank else F.col(c) for c in _OUT]), F.lit(True), F.lit(0))


def observe(snapshots: DataFrame, rules: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One observation per (run, source) from all its channels."""
    kinds = Kinds.of(rules)
    pages = read_pages(snapshots, rules, kinds)
    if not kinds.follow:
        parts = [_direct(pages)]
    else:
        pages = stored(pages, "listings")  # read for the choice, for the filter and for the rows themselves
        parts = [_direct(pages.filter(~F.col("follow"))), _followed(pages.filter("follow"), snapshots, rules, kinds)]
    if runs is not None:
        parts.append(weekly_observations(runs, rules))
    every = reduce(DataFrame.unionByName, parts)
    rest = [c for c in columns(OBSERVATIONS) if c not in RUN_KEY]
    best = F.min_by(F.struct(*rest), F.col("_rank")).alias("_best")
    return every.groupBy(*RUN_KEY).agg(best).select(*RUN_KEY, "_best.*").select(*columns(OBSERVATIONS))
