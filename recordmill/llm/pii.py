"""Personal data with offset-preserving deobfuscation.

Base spans come from the plain patterns over the source text. A chain of transducers then rewrites disguises (look-alike
characters, spelled digits, "at" and "dot" written out) while recording, for each character made, the source range it
came from (two arrays of integers, none where nothing was rewritten); identifiers found in the rewritten text are mapped
back to source characters and added where no base span of that kind covers them wholly. Texts that hold no disguise at all skip the rewriting.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.common import map_batches, ship, table, without

KINDS = ("email", "ip", "card", "phone")

# Starting a run of digits anywhere but at its head cannot match where the head did not, so lookbehinds only save time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@label(.label)+: found from each @ outwards, so long runs of letters cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def detect(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for kind, finder in (("ip", ips), ("card", cards), ("phone", phones)):
            found += [(kind, s, e) for s, e in finder(text)]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# Characters that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "﹒": ".",
    "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
_LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_LOOKALIKES |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}  # other digits
_STYLED = [*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x24B6, 0x24EB), 0xB2, 0xB3, 0xB9, *range(0x2070, 0x207A), *range(0x2080, 0x208A)]
#: Mathematical letters and digits, circled ones, digits set high or low, by their compatibility forms.
_LOOKALIKES |= {chr(c): plain for c in _STYLED if len(plain := unicodedata.normalize("NFKC", chr(c))) == 1 and plain.isascii() and plain.isalnum()}
_LOOKALIKES |= {c: "" for c in "\u200b\u200c\u200d\u2060\ufeff\u00ad"}  # characters without width
#: Searched in two steps, as a class that reaches beyond 16 bits is walked range by range.
_LOOKALIKE = re.compile("[" + re.escape("".join(c for c in _LOOKALIKES if c < "\U00010000")) + "]")
_WIDE_LOOKALIKE = re.compile("[\U0001d400-\U0001d7ff]")
_UNDISGUISED = str.maketrans(_LOOKALIKES)
_WIDTHLESS = np.array([ord(c) for c, plain in _LOOKALIKES.items() if not plain], np.uint32)

# Digits in words.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "|".join(sorted(map(re.escape, _DIGIT_WORDS), key=len, reverse=True))
#: At least seven digits in a row of which at least four are spelled; a leading "plus" becomes the sign.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ \-]*)?(?:(?:{_DIGIT_WORD}|[0-9])(?:[ \-,.]+|(?!\w))){{6,}}(?:{_DIGIT_WORD}|[0-9])(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"plus|{_DIGIT_WORD}|[0-9]|\+", re.I)
#: Of four spelled digits in such a run some word without a "plus" before it is followed by another digit, however they are dealt.
_SOME_SPELLED = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD})[ \-,.]+(?:{_DIGIT_WORD}|[0-9])(?!\w)", re.I)

_WRITTEN_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
_PLAIN_DOT = rf"(?:{_WRITTEN_DOT}|\.)"
_SURE_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*|\s*@\s*)"
_LOCAL_RUN = r"[A-Za-z0-9._%+-]++"
_LOCAL_PART = rf"{_LOCAL_RUN}(?:{_WRITTEN_DOT}{_LOCAL_RUN})*+"
_LABEL = r"[A-Za-z0-9-]+"
#: In "write me at jane dot doe at example dot com" the first "at" is prose: what follows it is an address with an "at" of its own.
_AT = rf"(?:{_SURE_AT}|\s+at\s+(?!{_LOCAL_PART}(?:{_SURE_AT}{_LABEL}\.?|\s+at\s+{_LABEL}(?:\.{_LABEL})*{_WRITTEN_DOT}){_LABEL}))"
#: A disguised address needs either a bracketed "at", or a written-out "dot"; plain prose with "at" is left alone.
#: Local parts without a domain match too, with an empty second group, so that a long chain of dots is read only once.
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])({_LOCAL_PART})(?:{_AT}({_LABEL}(?:{_PLAIN_DOT}{_LABEL})+))?", re.I)
_DISGUISED_NUMBERS = re.compile(rf"(?<![0-9])[0-9]++(?:{_PLAIN_DOT}[0-9]++){{3,}}", re.I)
_ANY_DOT = re.compile(_PLAIN_DOT, re.I)
_LOCAL_DOT = re.compile(_WRITTEN_DOT, re.I)
_DISGUISE_SIGN = re.compile(r"[\[({<]\s*(?:at|arroba|arobase|@|dot|punkt|point|punto|\.)\s*[\])}>]|\sdot\s|\spunkt\s|\spunto\s|\spoint\s", re.I)

#: "@" as URLs and HTML write it.
_ENCODED_AT = re.compile(r"(?<=[A-Za-z0-9._+-])(?:%40|&#0*+64;|&#[xX]0*+40;|&commat;)(?=[A-Za-z0-9-]++\.[A-Za-z])")
#: jane_at_example_dot_com, jane-at-example-dot-com
_JOINED_AT = re.compile(r"(?<=[A-Za-z0-9])([_-])at\1([A-Za-z0-9]++(?:\1dot\1[A-Za-z0-9]++)++)(?![A-Za-z0-9_-])", re.I)
_JOINED_DOT = re.compile(r"[_-]dot[_-]", re.I)
#: "jane @ example.com", and "jane.doe at example.com" or "jane7 at example.com"; prose has "at" before a host too ("look at example.com"),
#: so that without a bracket or a written dot only a local part that is no plain word counts.
_SPACED_AT = re.compile(
    rf"(?<![A-Za-z0-9._%+@-])(?:({_LOCAL_RUN})([ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})|(?=[A-Za-z][A-Za-z0-9]*+[._+0-9][A-Za-z0-9]|[A-Za-z]++[0-9]){_LOCAL_RUN}([ \t]+at[ \t]+))"
    rf"(?=[A-Za-z0-9-]++\.(?:[A-Za-z0-9-]++\.)*+[A-Za-z]{{2,}}+(?![A-Za-z0-9-]))",
    re.I,
)
_SPACED_SIGN = re.compile(r"[ \t]@|@[ \t]|[ \t]at[ \t]", re.I)
_JOINED_SIGN = re.compile(r"[_-]at[_-]", re.I)
_ENCODED_SIGN = re.compile(r"%40|&#|&commat;")


class Made:
    """A rewritten text, and for each of its characters the source range that it came from."""

    def __init__(self, text: str):
        """Look-alikes undone: one character each, or none, so that ranges are single characters of the source."""
        self.text = text.translate(_UNDISGUISED)
        if len(self.text) == len(text):
            self.starts = np.arange(len(text), dtype=np.int32)
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.starts = np.flatnonzero(~np.isin(codes, _WIDTHLESS)).astype(np.int32)
        self.ends = self.starts + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges, given in order and apart, each by a text whose every character carries the whole range's source."""
        s, e = np.array([x[0] for x in edits]), np.array([x[1] for x in edits])
        sizes = np.array([len(x[2]) for x in edits])
        cover = np.zeros(len(self.text) + 1, np.int8)
        cover[s] += 1
        cover[e] -= 1
        kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        order = np.argsort(np.concatenate([kept, np.repeat(s, sizes)]), kind="stable")
        self.starts = np.concatenate([self.starts[kept], np.repeat(self.starts[s], sizes)])[order]
        self.ends = np.concatenate([self.ends[kept], np.repeat(self.ends[e - 1], sizes)])[order]
        out, at = [], 0
        for start, end, new in edits:
            out += [self.text[at:start], new]
            at = end
        self.text = "".join([*out, self.text[at:]])


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        parts = [p for p in _SPELLED_PART.finditer(text, m.start(), m.end())]
        if sum(p[0].lower() in _DIGIT_WORDS for p in parts) < 4:
            continue
        for i, p in enumerate(parts):
            end = parts[i + 1].start() if i + 1 < len(parts) else p.end()
            out.append((p.start(), end, "+" if p[0].lower() in ("plus", "+") else _DIGIT_WORDS.get(p[0].lower(), p[0])))
    return out


def _local_dots(text: str, start: int, end: int, rest: str) -> list[tuple[int, int]]:
    """Written dots of a local part, from its end back to one that reads as prose.

    A word other than "dot" that stands without brackets ("our contact point jane@...") counts only where the domain uses it too.
    """
    out: list[tuple[int, int]] = []
    for m in reversed(list(_LOCAL_DOT.finditer(text, start, end))):
        word = m[0].strip().lower()
        if word in ("punkt", "point", "punto") and not re.search(rf"\s{word}\s", rest, re.I):
            break
        out.insert(0, m.span())
    return out


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _DISGUISED.finditer(text):
        if m[2] is None:
            continue
        dots = _local_dots(text, *m.span(1), m[2])
        if not dots and not _DISGUISE_SIGN.search(text, m.end(1), m.end()):
            continue
        out += [(s, e, ".") for s, e in dots]
        out.append((m.end(1), m.start(2), "@"))
        out += _dot_edits(text, m.start(2), m.end(2))
    return out


def _dot_edits(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(text, start, end) if len(d[0]) > 1]


def _encoded_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@") for m in _ENCODED_AT.finditer(text)]


def _joined_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _JOINED_AT.finditer(text):
        out.append((m.start(), m.start(2), "@"))
        out += [(d.start(), d.end(), ".") for d in _JOINED_DOT.finditer(text, m.start(2), m.end(2))]
    return out


def _spaced_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(2 if m[2] else 3), "@") for m in _SPACED_AT.finditer(text)]


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    return [x for m in _DISGUISED_NUMBERS.finditer(text) for x in _dot_edits(text, *m.span())]


_TRANSDUCERS = (
    (_SOME_SPELLED, _spelled_edits), (_ENCODED_SIGN, _encoded_edits), (_JOINED_SIGN, _joined_edits),
    (_DISGUISE_SIGN, _address_edits), (_SPACED_SIGN, _spaced_edits), (_DISGUISE_SIGN, _number_edits),
)


def deobfuscate(text: str) -> Made | None:
    """The text with disguises undone; None where there is nothing to undo."""
    made = Made(text) if not text.isascii() and (_LOOKALIKE.search(text) or _WIDE_LOOKALIKE.search(text)) else None
    for sign, edits_of in _TRANSDUCERS:
        current = made.text if made else text
        if sign.search(current) and (edits := edits_of(current)):
            made = made or Made(text)
            made.rewrite(edits)
    return made


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text, as (kind, start, end) in code points; null text has none."""
    text = text or ""
    base = detect(text)
    made = deobfuscate(text)
    if made is None:
        return base, []
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}  # apart and in order, within a kind
    added = []
    for kind, s, e in detect(made.text):
        s, e = int(made.starts[s]), int(made.ends[e - 1])
        at = bisect_right(taken[kind], s, key=lambda x: x[0])
        if not at or taken[kind][at - 1][1] < e:
            added.append((kind, s, e))
    return base, in_order(added)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every covered range replaced by the label of the first span that covers it."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _finder(text_at: int, kept: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            base, added = [], []
            for text in b.column(text_at).to_pylist():
                found, more = find(text)
                base.append(told(found))
                added.append(told(more))
            columns = [*[b.column(i) for i in kept], pa.array(base, _SPAN), pa.array(added, _SPAN)]
            yield pa.RecordBatch.from_arrays(columns, names=[*[b.schema.names[i] for i in kept], "__base", "__added"])

    return run


def _redactor(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for text in b.column(text_at).to_pylist():
                base, added = find(text)
                clean.append(None if text is None else redact(text, in_order([*base, *added])))
            columns = list(b.columns)
            columns[text_at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return run


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with ``__base`` and ``__added``: arrays of (kind, start, end), sorted, which replace columns of these names.

    Null or empty text has none; repeated rows give repeated results; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    kept = without(docs.columns, ["__base", "__added"])
    schema = T.StructType([*[docs.schema[i] for i in kept], T.StructField("__base", SPAN), T.StructField("__added", SPAN)])
    return map_batches(docs, _finder(docs.columns.index(text_col), kept), schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with every span, base or added, replaced by its kind in brackets; null text stays null."""
    ship(docs.sparkSession)
    return map_batches(docs, _redactor(docs.columns.index(text_col)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 are of the base spans; spans holds all of them; n_added counts what deobfuscation adds."""
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat("__base", "__added"), lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("n"), x["end"].alias("end"), x["kind"].alias("kind")))
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(told(F.col("__base")), 256).alias("base_sha256"), told(F.array_sort(keyed)).alias("spans"), F.size("__added").cast("long").alias("n_added")
    )
