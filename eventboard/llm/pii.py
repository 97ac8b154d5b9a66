"""Personal data in whole texts, plain or disguised, as spans of the source.

Plain identifiers are found by fixed patterns. For disguised ones a chain of transducers rewrites the text
(invisible characters go, homoglyphs become ASCII, spelled digits become digits, at/dot disguises become ``@`` and
``.``); every output character remembers the source range it came from, so that what the same patterns find in
the rewritten text is mapped back to source characters. A found span is added only if rewriting changed what it
covers and no plain span of its kind overlaps it; plain spans always stay.

Only texts with a digit, an ``@`` or something that a transducer changes are looked at character by character; which these
are follows from the transducers' own patterns, so no text is left out that has a span.

A spaced ``at`` stands for ``@`` if another sign of the address is disguised too, if the name before it has a letter and a
dot, digit, ``_``, ``%`` or ``+``, or if mail is announced just before ("e-mail: jane at example.com"). Else it is prose, as
in "us at example.com": a bare name before a plain domain is not told from a sentence. ``arroba`` always stands for ``@``.

Defined results: a NULL or empty text has no spans (``redact`` leaves NULL as it is). NULL ids, repeated rows and
very long texts are handled like any other row. Patterns run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventboard.llm.arrays import Block, blocks, table
from eventboard.llm.scratch import arrow_map

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

SPANS = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)
_SPANS = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)

# -- plain identifiers -----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Plain spans by kind, then start. A match that fails its check is dropped without another try."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


# -- transducers -----------------------------------------------------------------------------------

# Look-alikes of ASCII letters, in code point order.
_LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορτυχЅІЈАВЕКМНОРСТУХаеорсухѕіјԁ",
        "ABEZHIKMNOPTYXaivoptuxSIJABEKMHOPCTYXaeopcyxsijd",
        strict=True,
    )
)
# Names of the digits from zero, by language.
_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_SPELLED = {name: str(k) for names in _NAMES for k, name in enumerate(names.split())}
_NAME = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_RUN = re.compile(rf"(?i)\b(?:plus\s+)?{_NAME}(?:[\s,;-]+(?:{_NAME}\b|[0-9]+\b|dot\b|point\b))*[\s,;-]+{_NAME}\b")
_TOKEN = re.compile(r"(?i)plus\s+|[\s,;-]+|[^\s,;-]+")

_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*|\s+(?:at|arroba|[_-](?:at|arroba)[_-])\s+|&(?:#0*64|#x0*40|commat);)"
_DOT = (
    r"(?:\s*[\[({<]\s*(?:dot|punto|punkt|point|\.)\s*[\])}>]\s*"
    r"|\s+(?:dot|punto|punkt|point|[_-](?:dot|punto|punkt|point)[_-])\s+|&(?:#0*46|#x0*2e|period);)"
)
_MAIL = re.compile(
    rf"(?i)(?<![a-z0-9._%+-])[a-z0-9_%+-]+(?:(?:\.|{_DOT})[a-z0-9_%+-]+)*(?:{_AT}|@)[a-z0-9-]+(?:(?:\.|{_DOT})[a-z0-9-]+)+"
)
_SIGNS = re.compile(rf"(?i)({_AT})|{_DOT}")
_NUMBERS = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")

# A bare word before a spaced "at" and a plainly dotted domain is prose ("us at example.com"), unless mail was announced.
_SPACED_AT = re.compile(r"(?i)\s+at\s+")
_ANNOUNCED = re.compile(r"(?i)\b(?:e-?mail|mailto|mail|correo)(?:\s+(?:address|adresse|is|ist|est|es|to|an|a))*\s*[:=]?\s*$")
_PRONOUNS = frozenset("me us you him her it them".split())


@dataclass
class Rewritten:
    """A text and, for each of its characters, the source range it stands for."""

    text: str
    start: list[int]
    end: list[int]

    def edit(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replaces ranges; all characters of a replacement stand for the whole range replaced."""
        if not edits:
            return self
        parts, start, end, done = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[done:a], new]
            start += self.start[done:a] + [self.start[a]] * len(new)
            end += self.end[done:a] + [self.end[b - 1]] * len(new)
            done = b
        parts.append(self.text[done:])
        return Rewritten("".join(parts), start + self.start[done:], end + self.end[done:])


def _ascii_of(c: str) -> str | None:
    """What a disguised character stands for: empty for invisible ones, None if it stands for itself."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    plain_form = unicodedata.normalize("NFKC", c)
    return plain_form if len(plain_form) == 1 and " " < plain_form <= "~" else None


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    found = ((k, k + 1, _ascii_of(c)) for k, c in enumerate(text) if c > "\x7f")
    return [x for x in found if x[2] is not None]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Digits for runs of spelled ones; a spelled dot between them becomes ``.``."""
    out = []
    for run in _RUN.finditer(text):
        if len(re.findall(rf"(?i){_NAME}\b", run[0])) < 3:
            continue
        for token in _TOKEN.finditer(run[0]):
            word = token[0].strip().lower()
            a, b = run.start() + token.start(), run.start() + token.end()
            if word in _SPELLED:
                out.append((a, b, _SPELLED[word]))
            elif word in ("dot", "point", "plus"):
                out.append((a, b, "+" if word == "plus" else "."))
            elif not word.strip(",;-"):
                out.append((a, b, ""))
    return out


def _is_local(text: str, start: int, end: int) -> bool:
    """Whether what stands before a spaced "at" names a mailbox, not the last word of a sentence."""
    local = text[start:end]
    if any(c in "._%+0123456789" for c in local):
        return any(c.isalpha() for c in local)
    return local.lower() not in _PRONOUNS and bool(_ANNOUNCED.search(text, max(0, start - 40), start))


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """``@`` and ``.`` for disguises inside what reads as an address or as a dotted number."""
    out: dict[tuple[int, int], str] = {}
    for pattern in (_MAIL, _NUMBERS):
        for whole in pattern.finditer(text):
            signs = list(_SIGNS.finditer(text, *whole.span()))
            if len(signs) == 1 and _SPACED_AT.fullmatch(signs[0][0]) and not _is_local(text, whole.start(), signs[0].start()):
                continue
            for sign in signs:
                out[sign.span()] = "@" if sign[1] else "."
    edits, done = [], 0
    for (a, b), new in sorted(out.items()):
        if a >= done:
            edits.append((a, b, new))
            done = b
    return edits


# -- what the transducers can change, in lower-cased bytes ---------------------------------------------

_LATIN_END = 0x240
#: Two-byte characters that stand for ASCII ones, or match ASCII letters where case is ignored.
_ODD_LATIN = "".join(
    c for c in map(chr, range(0x80, _LATIN_END)) if _ascii_of(c) is not None or re.fullmatch("(?i)[a-z]", c)
)
_GAP = r"(?:[\s\x1c-\x1f]|\xc2[\x85\xa0])"
_BETWEEN = rf"(?:[\s\x1c-\x1f,;-]|\xc2[\x85\xa0])+"


def _in_bytes(*patterns: str) -> re.Pattern[bytes]:
    """Names hold Latin letters, whose upper case stays upper case when bytes are lower-cased."""
    joined = "|".join(patterns)
    for c in {c for c in joined if c > "\x7f"}:
        joined = joined.replace(c, f"(?:{c}|{c.upper()})")
    return re.compile(joined.encode())


#: Every text that a transducer changes has one of these, or a byte of ``_LATIN_END`` or beyond. What follows is only looked
#: at, so a match does not reach into the next text.
_DISGUISE = (
    re.compile("|".join(_ODD_LATIN).encode()),
    _in_bytes(rf"[\[({{<](?={_GAP}*(?:at|arroba|@|dot|punto|punkt|point|\.){_GAP}*[\])}}>])"),
    _in_bytes(rf"{_GAP}(?:dot|punto|punkt|point)(?={_GAP})"),
    _in_bytes(rf"{_GAP}(?:at|arroba)(?={_GAP}+[a-z0-9-]++\.[a-z0-9-])"),
    _in_bytes(rf"{_GAP}[_-](?=(?:at|arroba|dot|punto|punkt|point)[_-]{_GAP})"),
    _in_bytes(r"&(?=#0*(?:64|46);|#x0*(?:40|2e);|commat;|period;)"),
    _in_bytes(rf"\b{_NAME}(?={_BETWEEN}(?:{_NAME}\b|[0-9]|dot\b|point\b))"),
)


def rewrite(text: str) -> Rewritten:
    out = Rewritten(text, list(range(len(text))), list(range(1, len(text) + 1)))
    for transducer in (_homoglyphs, _spelled, _disguised):
        out = out.edit(transducer(out.text))
    return out


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers, by kind, then start; a plain span inside a longer one does not hide it."""
    new = rewrite(text)
    if new.text == text:
        return []
    out = []
    for kind, a, b in plain(new.text):
        start, end = new.start[a], new.end[b - 1]
        disguised = text[start:end] != new.text[a:b]
        if disguised and (kind, start, end) not in base:
            out.append((kind, start, end))
    return out


# -- texts of a block ------------------------------------------------------------------------------


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _wanted(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may hold plain identifiers, and rows that may hold disguised ones."""

    def rows(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), dtype=bool)
        out[np.searchsorted(block.at, places, "right") - 1] = True
        return out

    data = block.data
    is_plain = rows(np.flatnonzero((data == ord("@")) | ((data >= ord("0")) & (data <= ord("9")))))
    lower = data.tobytes().lower()
    hits = np.array([m.start() for pattern in _DISGUISE for m in pattern.finditer(lower)], dtype=np.int64)
    strange = np.flatnonzero(data >= chr(_LATIN_END).encode()[0])
    return is_plain, rows(np.concatenate([hits, strange]))


def found(block: Block) -> Iterator[tuple[int, list[Span], list[Span]]]:
    """Row, plain spans and added spans of the rows that have any."""
    is_plain, is_odd = _wanted(block)
    for k in np.flatnonzero(is_plain | is_odd):
        text = block.text(k)
        base = plain(text) if is_plain[k] else []
        more = added(text, base) if is_odd[k] else []
        if base or more:
            yield int(k), base, more


def _order(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def spans(docs: DataFrame) -> DataFrame:
    """``SPANS`` of every text: counts and digest of the plain spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((4, n), dtype=np.int64)
            digest, listed, extra = [nothing] * n, [""] * n, np.zeros(n, dtype=np.int64)
            for block in blocks(batch.column("text")):
                for k, base, more in found(block):
                    row = block.rows.start + k
                    for kind, *_ in base:
                        counts[KINDS.index(kind), row] += 1
                    digest[row] = hashlib.sha256(_listed(base).encode()).hexdigest()
                    listed[row], extra[row] = _listed(sorted(base + more, key=_order)), len(more)
            yield table(_SPANS, [batch.column("doc_id").cast(pa.int64()), *counts, digest, listed, extra])

    return arrow_map(docs.select("doc_id", "text"), run, SPANS)


def _masked(text: str, all_spans: list[Span]) -> str:
    parts, done = [], 0
    for kind, a, b in sorted(all_spans, key=lambda s: (s[1], -s[2])):
        if b <= done:
            continue
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; overlapping spans share one ``[KIND]`` mark, and ``n_chars``, if there, follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            changed = {}
            for block in blocks(texts):
                for k, base, more in found(block):
                    changed[block.rows.start + k] = _masked(block.text(k), base + more)
            if changed:
                values = texts.to_pylist()
                for k, text in changed.items():
                    values[k] = text
                place = batch.schema.get_field_index("text")
                batch = batch.set_column(place, batch.schema.field(place), pa.array(values, texts.type))
                place = batch.schema.get_field_index("n_chars")
                if place >= 0 and pa.types.is_integer(batch.schema.field(place).type):
                    lengths = batch.column(place).to_pylist()
                    for k, text in changed.items():
                        lengths[k] = len(text)
                    batch = batch.set_column(place, batch.schema.field(place), pa.array(lengths, batch.schema.field(place).type))
            yield batch

    return arrow_map(docs, run, docs.schema)
