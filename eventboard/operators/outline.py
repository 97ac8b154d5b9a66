"""The one Python step: an HTML body becomes an array of selected elements.

Runs as an Arrow UDF inside the scan's own tasks, so no page leaves its row and nothing is
shuffled. It only finds elements and their text; dates, keywords and picks are Spark expressions.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

# A selector's parts must all hold; NULL parts are ignored. ``cls_like`` and ``href`` are substrings,
# ``within`` is the class of some enclosing element.
SELECTOR = "struct<tag:string,id:string,cls:string,cls_like:string,href:string,within:string>"
SELECTOR_FIELDS = ["tag", "id", "cls", "cls_like", "href", "within"]
PAGE = "#page"

MARK = (
    "struct<tag:string,classes:array<string>,datetime:string,content:string,title:string,"
    "text:string,header:boolean>"
)
ELEMENT = (
    "struct<pos:int,kept:boolean,parent_at:int,grand_at:int,card_at:int,parent_pos:int,tag:string,"
    "classes:array<string>,attrs:map<string,string>,text:string,href:string,link_text:string,"
    f"times:array<{MARK}>,headings:array<struct<tag:string,classes:array<string>,text:string>>>"
)

# HTML's void elements, and which open element an opening tag closes (up to a boundary).
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SIBLING_ENDS = {
    "li": ("ul", "ol"),
    "tr": ("table", "thead", "tbody"),
    "td": ("tr",),
    "th": ("tr",),
    "p": ("div", "article", "section", "main", "li", "td", "body"),
}
HEADER_CLASSES = {"article-header", "news-detail__header"}
PUBLISHED_META = {"article:published_time", "publish-date"}
#: Pages whose elements are Python objects at one time; those before are an Arrow array already.
CHUNK = 64


class _Outline(HTMLParser):
    """Elements in document order with text offsets into one concatenated text."""

    def __init__(self, drop_noscript: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.muted_tags = {"script", "style"} | ({"noscript"} if drop_noscript else set())
        self.tags, self.attrs, self.parents = [PAGE], [{}], [-1]
        self.starts, self.ends, self.lasts = [0], [0], [0]
        self.open, self.chunks, self.size, self.muted = [0], [], 0, []

    def handle_starttag(self, tag, attrs):
        if self.muted:
            if tag == self.muted[-1]:
                self.muted.append(tag)
            return
        if tag in self.muted_tags or (tag == "title" and not any(self.tags[i] == "svg" for i in self.open)):
            self.muted.append(tag)
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[i]]
            if name == tag and tag in SIBLING_ENDS:
                self._close_from(i)
                break
            if name in SIBLING_ENDS.get(tag, (name,)):
                break
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parents.append(self.open[-1])
        self.starts.append(self.size)
        self.ends.append(self.size)
        self.lasts.append(len(self.tags) - 1)
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_endtag(self, tag):
        if self.muted:
            if tag == self.muted[-1]:
                self.muted.pop()
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[i]] == tag:
                self._close_from(i)
                return

    def handle_data(self, data):
        if not self.muted:
            self.chunks.append(data)
            self.size += len(data)

    def _close_from(self, i):
        for node in self.open[i:]:
            self.ends[node], self.lasts[node] = self.size, len(self.tags) - 1
        del self.open[i:]

    def updatepos(self, i, j):
        """Lines and columns are not asked for."""
        return j

    def finish(self):
        self.close()
        self._close_from(0)
        self.text = "".join(self.chunks)
        self.classes = [a.get("class", "").split() for a in self.attrs]

    def up(self, node):
        node = self.parents[node]
        while node >= 0:
            yield node
            node = self.parents[node]

    def matches(self, node, selectors):
        for s in selectors:
            if s["tag"] is not None and self.tags[node] != s["tag"]:
                continue
            if s["id"] is not None and s["id"] != self.attrs[node].get("id"):
                continue
            if s["cls"] is not None and s["cls"] not in self.classes[node]:
                continue
            if s["cls_like"] is not None and s["cls_like"] not in self.attrs[node].get("class", ""):
                continue
            if s["href"] is not None and s["href"] not in self.attrs[node].get("href", ""):
                continue
            if s["within"] is not None and not any(s["within"] in self.classes[u] for u in self.up(node)):
                continue
            return True
        return False

    def text_of(self, node):
        return self.text[self.starts[node] : self.ends[node]]


def _is_mark(o: _Outline, i: int) -> bool:
    a = o.attrs[i]
    return (
        o.tags[i] == "time"
        or "date" in a.get("class", "")
        or "published-at" in o.classes[i]
        or (o.tags[i] == "meta" and (a.get("property") in PUBLISHED_META or a.get("name") in PUBLISHED_META))
    )


def _elements(body: str | None, selectors, closest, drop_noscript) -> list[dict] | None:
    if body is None or selectors is None:
        return None
    o = _Outline(bool(drop_noscript))
    o.feed(body)
    o.finish()
    nodes = range(len(o.tags))
    marks = [i for i in nodes if i and _is_mark(o, i)]
    heads = [i for i in nodes if o.tags[i] in ("h1", "h2", "h3", "h4") or "title" in o.attrs[i].get("class", "")]
    links = [i for i in nodes if o.tags[i] == "a"]
    header = next((i for i in nodes if o.tags[i] == "header" or HEADER_CLASSES & set(o.classes[i])), None)
    kept = [i for i in nodes if o.matches(i, selectors)]
    # Enclosing elements are listed too when the caller asks for a closest card, once each.
    wanted, nearest = set(kept), {}
    if closest is not None:
        for i in kept:
            nearest[i] = next((u for u in (i, *o.up(i)) if o.matches(u, closest)), None)
            wanted.update(u for u in [nearest[i], *list(o.up(i))[:2]] if u is not None)
    order = sorted(wanted)
    at = {node: k for k, node in enumerate(order)}

    def inside(found, i):
        return found[bisect_right(found, i) : bisect_left(found, o.lasts[i] + 1)]

    def mark(i):
        a = o.attrs[i]
        in_header = header is not None and header < i <= o.lasts[header]
        return dict(
            tag=o.tags[i], classes=o.classes[i], datetime=a.get("datetime"), content=a.get("content"),
            title=a.get("title"), text=o.text_of(i), header=in_header,
        )

    keeps, out = set(kept), []
    for i in order:
        above = list(o.up(i))[:2]
        inner = inside(links, i)
        # An element without links of its own stands for itself.
        anchor = inner[0] if inner else i
        out.append(
            dict(
                pos=i, kept=i in keeps,
                parent_at=at.get(above[0]) if above else None,
                grand_at=at.get(above[1]) if len(above) > 1 else None,
                card_at=at.get(nearest.get(i)),
                parent_pos=above[0] if above else None,
                tag=o.tags[i], classes=o.classes[i], attrs=list(o.attrs[i].items()), text=o.text_of(i),
                href=o.attrs[anchor].get("href"),
                link_text="".join(o.text_of(k) for k in inner) if inner else o.text_of(i),
                times=[mark(k) for k in inside(marks, i)],
                headings=[dict(tag=o.tags[k], classes=o.classes[k], text=o.text_of(k)) for k in inside(heads, i)],
            )
        )
    return out


def _decoded(selectors: str | None, known: dict) -> list[dict] | None:
    """Selector records of a JSON text; ``known`` remembers the few distinct texts of a batch."""
    if selectors is not None and selectors not in known:
        known[selectors] = [{**dict.fromkeys(SELECTOR_FIELDS), **s} for s in json.loads(selectors)]
    return known.get(selectors)


def _outline_udf():
    # The parser travels with the task, so executors need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    returned = f"array<{ELEMENT}>"
    arrow_type = to_arrow_type(_parse_datatype_string(returned))

    @F.arrow_udf(returned)
    def outline(body: pa.Array, selectors: pa.Array, closest: pa.Array, drop: pa.Array) -> pa.Array:
        known: dict = {}
        parts = []
        for at in range(0, len(body), CHUNK):
            rows = zip(*(column.slice(at, CHUNK).to_pylist() for column in (body, selectors, closest, drop)), strict=True)
            found = [_elements(b, _decoded(s, known), _decoded(c, known), d) for b, s, c, d in rows]
            parts.append(pa.array(found, arrow_type))
        return pa.concat_arrays(parts) if parts else pa.array([], arrow_type)

    return outline


def selector(text: str) -> dict[str, str | None]:
    """``tag``, ``#id``, ``.class``, ``tag*part``, ``a@href-part`` and ``.outer tag`` as a selector record."""
    record = dict.fromkeys(SELECTOR_FIELDS)
    if text == PAGE:
        return record | {"tag": PAGE}
    if " " in text:
        outer, text = text.split(" ", 1)
        record["within"] = outer.removeprefix(".")
    for sign, field in (("@", "href"), ("*", "cls_like"), (".", "cls"), ("#", "id")):
        if sign in text:
            text, record[field] = text.split(sign, 1)
            break
    record["tag"] = text or None
    return record


def selectors_column(texts: list[str]) -> Column:
    return F.lit(json.dumps([selector(t) for t in texts]))


def elements(body: Column, selectors: Column, closest: Column | None = None, drop_noscript: Column | None = None) -> Column:
    """Array of the elements matching ``selectors``, in document order, NULL for a NULL body.

    ``selectors`` and ``closest`` are JSON lists of selector records, one short string per row.
    """
    return _outline_udf()(
        body,
        selectors,
        closest if closest is not None else F.lit(None).cast("string"),
        drop_noscript if drop_noscript is not None else F.lit(True),
    )
