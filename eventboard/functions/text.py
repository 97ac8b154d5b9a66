"""HTML text, urls and titles as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define what page text, links and headings are.
SCRIPT = r"(?is)<script\b[^>]*>.*?</script>"
STYLE = r"(?is)<style\b[^>]*>.*?</style>"
NOSCRIPT = r"(?is)<noscript\b[^>]*>.*?</noscript>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]*>?"
SPACES = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
OPENING_TAG = r"(?s)^<[^>]*>"
HEADING = r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>"
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&nbsp;", " "),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
]


def decode_entities(c: Column) -> Column:
    """Decode the common entities; ``&amp;`` last so nothing is decoded twice."""
    decoded = c
    for entity, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_noise(c: Column, noscript: bool = True) -> Column:
    """Drop script, style and (by default) noscript subtrees."""
    out = F.regexp_replace(F.regexp_replace(c, SCRIPT, ""), STYLE, "")
    return F.regexp_replace(out, NOSCRIPT, "") if noscript else out


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def html_to_text(c: Column, sep: str = " ") -> Column:
    """Text of an HTML fragment.

    ``sep=' '`` puts a space for every tag and leaves entities alone; ``sep=''`` joins neighbouring
    elements without a separator, drops comments and decodes entities, as a DOM's text does.
    """
    if sep:
        return collapse(F.regexp_replace(strip_noise(c, noscript=False), TAG, sep))
    bare = F.regexp_replace(strip_noise(c, noscript=False), COMMENT, "")
    return decode_entities(F.regexp_replace(bare, TAG, ""))


def page_text(body: Column, mode: Column) -> Column:
    """Spaced text of a rendered or HTML page; any other body is passed through unchanged."""
    is_html = (F.coalesce(mode, F.lit("http")) == "browser") | F.contains(body, F.lit("<html"))
    return F.when(is_html, html_to_text(body)).otherwise(body)


def strip(c: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACES}|{SPACES}$", "")


def attribute(tag: Column, name: str) -> Column:
    """One attribute's value out of an opening tag, entity-decoded; NULL if absent or empty."""
    quoted = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    # Exactly one of the three alternatives is non-empty.
    value = F.concat(*[F.regexp_extract(tag, quoted, i) for i in (1, 2, 3)])
    return F.nullif(F.trim(decode_entities(value)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_heading(body: Column) -> Column:
    """Trimmed text of the first h1-h3 heading, NULL if there is none."""
    return blank_to_null(html_to_text(F.regexp_extract(body, HEADING, 1), sep=""))


def first_chars(c: Column, n: int = 50) -> Column:
    return strip(F.substring(c, 1, n))


def first_line(c: Column) -> Column:
    return F.split_part(strip(c), F.lit("\n"), F.lit(1))


def resolve_url(href: Column, base: Column | str, cut_query: bool = False) -> Column:
    """Absolute form of ``href`` against ``base``; NULL for blank and ``#fragment`` references."""
    base = F.lit(base) if isinstance(base, str) else base
    href = F.trim(href)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/(?:.*/)?", 0)
    folder = F.coalesce(F.nullif(folder, F.lit("")), F.concat(origin, F.lit("/")))
    joined = (
        F.when(href.isNull() | (href == "") | href.startswith("#"), F.lit(None).cast("string"))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
    # Bound once, so that the long expression above is neither repeated nor evaluated again.
    out = F.get(F.transform(F.array(joined), _without_dot_segments), 0)
    return F.split_part(out, F.lit("?"), F.lit(1)) if cut_query else out


def _without_dot_segments(url: Column) -> Column:
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"
    head, path, tail = (F.regexp_extract(url, parts, i) for i in (1, 2, 3))
    walked = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when((part == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(part == "..", acc)
        .otherwise(F.concat(acc, F.array(part))),
    )
    has_dots = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/\.\.?(?:[/?#]|$)")
    return F.when(has_dots, F.concat(head, F.array_join(walked, "/"), tail)).otherwise(url)
