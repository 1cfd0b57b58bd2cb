"""Personal data in whole texts, plain or disguised.

Plain identifiers are found in the text as it stands. For disguised ones,
transducers rewrite homoglyphs, spelled digits and at/dot disguises and keep,
for every character they write, the source span it came from; identifiers found
in the rewritten text are mapped back through these spans. All offsets are code
points of the source text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can begin inside a run of digits, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Matches of the e-mail pattern, found from each @ leftwards: linear on long runs of local characters."""
    before = 0
    for m in _AT_DOMAIN.finditer(text):
        start = m.start()
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            before = m.end()
            yield start, before


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


_FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def find_plain(text: str) -> dict[str, list[Span]]:
    """Spans by kind of what the text shows openly."""
    digits = _DIGIT.search(text) is not None
    has = {"email": "@" in text, "ip": digits and "." in text, "card": digits, "phone": digits and "+" in text}
    return {k: list(_FINDERS[k](text)) if has[k] else [] for k in KINDS}


# ---- transducers -------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "ց": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u202f": " ",
}
#: Characters without width, which are left out.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digit words by language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_VALUES = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_VALUES, key=len, reverse=True)) + ")"
_DOT_WORD = r"(?:dot|point|punkt|punto)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: Letters, digits and signs outside the Latin blocks that NFKC, a digit value or LOOKALIKES may turn into ASCII.
_STRANGE = (
    rf"[{INVISIBLE}  Ͱ-ԯա-ֆ٠-٩۰-۹०-९০-৯๐-๙"
    r"‐-–․⁰-⁹−①-⓿。﹒-﹫！-～\U0001d400-\U0001d7ff]"
)
_FEW = r"\s{0,3}"
# Every repetition is bounded or consumes what it matches, so long runs of one character take linear time.
_TOKEN = re.compile(
    rf"(?P<strange>{_STRANGE})"
    rf"|(?P<at>{_FEW}{_OPEN}{_FEW}(?:at|@){_FEW}{_CLOSE}{_FEW})"
    rf"|(?P<dot>{_FEW}{_OPEN}{_FEW}(?:{_DOT_WORD}|\.){_FEW}{_CLOSE}{_FEW})"
    rf"|(?P<spelled>\b(?:plus[\s-]{{1,3}})?{_WORD}(?:(?:[\s,-]{{1,3}}|\s{{1,3}}{_DOT_WORD}\s{{1,3}}){_WORD}){{3,}}\b)"
    rf"|(?P<spaced_at>\s{{1,3}}at\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:\s{{1,3}}|{_FEW}{_OPEN}{_FEW}){_DOT_WORD}\b))"
    rf"|(?P<sign_at>(?:\s{{1,3}}@{_FEW}|@\s{{1,3}})(?=[A-Za-z0-9-]{{1,63}}(?:{_FEW}\.{_FEW}|\s{{1,3}}{_DOT_WORD}\s{{1,3}}|{_FEW}{_OPEN})))"
    rf"|(?P<spaced_dot>(?<=[A-Za-z0-9])\s{{1,3}}{_DOT_WORD}\s{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<sign_dot>(?<=[A-Za-z0-9])\s{{1,3}}\.\s{{1,3}}(?=[a-z]))",
    re.IGNORECASE,
)
_PIECE = re.compile(rf"(?P<plus>plus[\s-]{{1,3}})|(?P<dot>\s{{1,3}}{_DOT_WORD}\s{{1,3}})|(?P<word>{_WORD})|[\s,-]{{1,3}}", re.IGNORECASE)
#: Cheap signs that a text may hold a disguise; a text without one shows nothing more when it is rewritten.
_HINT_STRANGE = re.compile(_STRANGE)
_HINT_BRACKETS = re.compile(rf"{_OPEN}{_FEW}(?:at|@|{_DOT_WORD}|\.){_FEW}{_CLOSE}", re.IGNORECASE)
_HINT_SIGN = re.compile(r"\s@|@\s|\s\.\s")
_DOTS = frozenset(("dot", "point", "punkt", "punto"))


def _fold(text: str) -> str:
    """Letters that the patterns hold equal, made equal."""
    return text.replace("\u0131", "i").replace("\u0130", "i").casefold()


@dataclass
class Rewritten:
    """A rewritten text in pieces: from ``begins[i]`` on it shows ``sources[i]``, letter by letter or, where ``whole[i]``, as one."""

    text: str
    begins: list[int]
    sources: list[Span]
    whole: list[bool]

    def source_span(self, start: int, end: int) -> Span:
        """The source span of the characters ``start:end``."""
        i, j = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        begin = self.sources[i][0] if self.whole[i] else self.sources[i][0] + start - self.begins[i]
        return begin, self.sources[j][1] if self.whole[j] else self.sources[j][0] + end - self.begins[j]


def _plain_character(c: str) -> str:
    if c in INVISIBLE:
        return ""
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    plain = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


def rewrite(text: str) -> Rewritten:
    """Run the transducers over a whole text."""
    parts: list[str] = []
    begins: list[int] = []
    sources: list[Span] = []
    whole: list[bool] = []
    at = size = 0

    def put(out: str, start: int, end: int, as_one: bool = True) -> None:
        nonlocal size
        if out:
            parts.append(out)
            begins.append(size)
            sources.append((start, end))
            whole.append(as_one)
            size += len(out)

    def keep(start: int, end: int) -> None:
        put(text[start:end], start, end, False)

    for m in _TOKEN.finditer(text):
        keep(at, m.start())
        start, at = m.span()
        kind = m.lastgroup
        if kind == "spelled":
            for piece in _PIECE.finditer(text, start, at):
                if word := piece["word"]:
                    put(_VALUES[_fold(word)], *piece.span())
                elif piece["dot"] or piece["plus"]:
                    put("." if piece["dot"] else "+", *piece.span())
        elif kind == "strange":
            put(_plain_character(m[0]), start, at)
        else:
            put("@" if kind in ("at", "spaced_at", "sign_at") else ".", start, at)
    keep(at, len(text))
    return Rewritten("".join(parts), begins, sources, whole)


def may_be_disguised(text: str) -> bool:
    """Whether rewriting may show more: a strange character, a bracketed or spaced sign, a dot word, or digit words in a row."""
    if not text.isascii() and _HINT_STRANGE.search(text) or _HINT_BRACKETS.search(text) or "@" in text and _HINT_SIGN.search(text):
        return True
    words = _fold(text).replace(",", " ").replace("-", " ").split()
    if not _DOTS.isdisjoint(words):
        return True
    # Of four digit words in a row, the two in the middle touch no other signs.
    digits = list(map(_VALUES.__contains__, words))
    return any(map(and_, digits, digits[1:]))


with open(os.path.join(os.path.dirname(__file__), "top_level_domains.txt"), encoding="utf-8") as _lines:
    TOP_LEVEL = frozenset(w for line in _lines if not line.startswith("#") for w in line.split())
#: Words of sentences that stand around ``at`` and ``point`` in plain prose, by language.
ENGLISH_WORDS = frozenset(
    """
    a an the this that these those some any no one each every another what which such same its his her their our your my it he she they we you i me us him them
    in on at to of by for from with as is was are were be been so and or but if when where while then than there here now not do does did has have had
    """.split()
)
SENTENCE_WORDS = ENGLISH_WORDS | frozenset(
    """
    am im um ob an es er sie wir ihr du ich der die das den dem des ein eine einen einem einer dieser diese diesem diesen jener jedem und oder aber nicht so zu
    le la les un une des de du ce cet cette ces mon ma ton ta son sa il elle on nous vous ils et ou mais ne pas se si au aux en y a
    el los las uno una unos unas este esta ese esa lo su sus mi tu al del y o pero no se si que
    """.split()
)
_STRONG_AT = re.compile(rf"{_OPEN}{_FEW}(?:at|@){_FEW}{_CLOSE}|\S@\S", re.IGNORECASE)
_AT_WORD = re.compile(r"\sat\s", re.IGNORECASE)
_POINT_WORD = re.compile(r"\s(point|punkt|punto)\s", re.IGNORECASE)
_SPACED_SIGN = re.compile(r"\s\.\s")
#: Words of sentences that are the domain of the language whose dot word stands before them.
_OWN_DOMAIN = {"punkt": "de", "punto": "es"}


def plausible_email(source: str, address: str) -> bool:
    """Whether ``source``, which was rewritten to ``address``, is a hidden address rather than prose with "at" and "point".

    A bracketed ``at``, or an @ without blanks, is enough. Otherwise the last label
    must be a top-level domain; next to the word ``at`` neither the local part nor
    the first label may be a word of sentences, and behind ``point`` (or ``punkt``,
    ``punto``, but for the domain of that language) or a spaced dot (English words)
    no such word is a domain.
    """
    if _STRONG_AT.search(source):
        return True
    local, _, host = address.lower().rpartition("@")
    labels = host.split(".")
    last = labels[-1]
    if last not in TOP_LEVEL and not (len(last) == 2 and last.isascii() and last.isalpha()):
        return False
    if _AT_WORD.search(source) and (labels[0] in SENTENCE_WORDS or local in SENTENCE_WORDS):
        return False
    if _SPACED_SIGN.search(source) and last in ENGLISH_WORDS:
        return False
    points = {w.lower() for w in _POINT_WORD.findall(source)}
    return not points or last not in SENTENCE_WORDS or last in {_OWN_DOMAIN.get(w) for w in points}


def find_disguised(text: str, plain: dict[str, list[Span]], gate: bool = True) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows; those that meet a plain span of their kind are left out.

    Rewriting is repeated once, since a homoglyph may stand inside a disguise. An
    e-mail address must be plausible, see ``plausible_email``.
    Without ``gate`` a text is rewritten whether or not it shows signs of a disguise.
    """
    if gate and not may_be_disguised(text):
        return {k: [] for k in KINDS}
    first = rewrite(text)
    second = rewrite(first.text)
    found: dict[str, list[Span]] = {}
    for kind, spans in find_plain(second.text).items():
        found[kind], ends = [], [e for _, e in plain[kind]]
        for start, end in spans:
            begin, stop = first.source_span(*second.source_span(start, end))
            # The first plain span that ends behind the beginning; plain spans are in order and apart.
            k = bisect_right(ends, begin)
            if kind == "email" and not plausible_email(text[begin:stop], second.text[start:end]):
                continue
            if text[begin:stop] != second.text[start:end] and (k == len(ends) or plain[kind][k][0] >= stop):
                found[kind].append((begin, stop))
    return found


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(documents: DataFrame) -> DataFrame:
    """Find personal data in every text of ``documents`` (doc_id, text); a row per row.

    Counts and ``spans`` cover plain and disguised identifiers; ``base_sha256``
    covers the plain ones alone; ``n_added`` counts the disguised ones. A null or
    empty text has none; null and repeated doc_ids pass through; other columns
    are left out. Narrow: rows are read once and never shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = find_plain(text or "")
                added = find_disguised(text or "", plain)
                every = {k: plain[k] + added[k] for k in KINDS}
                rows.append((doc_id, *(len(every[k]) for k in KINDS), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every), sum(map(len, added.values()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (5, 6) else pa.int64()) for i, c in enumerate(zip(*rows) if rows else [[]] * 8)], _NAMES)

    return documents.select("doc_id", "text").mapInArrow(scan, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def mask(text: str | None, label: str = "<{}>") -> str | None:
    """The text with every identifier replaced by its kind; overlapping spans are merged."""
    if not text:
        return text
    plain = find_plain(text)
    added = find_disguised(text, plain)
    spans = sorted((s, -e, k) for k in KINDS for s, e in plain[k] + added[k])
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], label.format(kind.upper())]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def mask_personal_data(documents: DataFrame, label: str = "<{}>") -> DataFrame:
    """``documents`` with identifiers in ``text`` replaced by their kind; all rows and columns stay.

    ``n_chars``, if there, is counted anew.
    """
    position = documents.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.field(position)
            masked = pa.array([mask(t, label) for t in batch.column(position).to_pylist()], column.type)
            yield batch.set_column(position, column, masked)

    masked = documents.mapInArrow(scan, documents.schema)
    if "n_chars" not in documents.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
