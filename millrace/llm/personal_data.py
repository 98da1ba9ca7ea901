"""Personal data in texts: plain patterns, and disguised ones undone by offset-preserving transducers.

The plain identifiers of a batch of texts are read off character classes in numpy, in time linear
in the bytes. A text is then rewritten by three transducers, each of which says which source
characters every rewritten stretch stands for: look-alike characters become ASCII, spelled digits
become digits, and written-out ``at`` and ``dot`` become ``@`` and ``.``. The same patterns are
read in the rewritten text, and a span that holds a rewritten stretch is mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import byte_view, slices

KINDS = ("email", "ip", "card", "phone")

# Cyrillic and Greek letters that look like Latin ones, and those Latin ones.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁһкмтвнАВЕКМНОРСТХУІЈЅαοορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhkmtbhABEKMHOPCTXYIJSaooovlktuxABEZHIKMNOPTYX",
    )
)
LOOK_ALIKES |= {"ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k"}
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
DASHES = "".join(map(chr, (*range(0x2010, 0x2016), 0x2212)))
DIGITS = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
SPELLED_RUN = 4

# Blanks are bounded, so that a long run of them costs no more than its length.
GAP = "[ \\t]{1,3}"
BEFORE = r"[ \t]{0,3}[(\[{<][ \t]{0,3}"
AFTER = r"[ \t]{0,3}[)\]}>][ \t]{0,3}"
AT_WORDS = r"(?:at|arroba|ät)"
DOT_WORDS = r"(?:dot|punto|punkt|point)"
LABEL = r"[A-Za-z0-9-]+"
DOT = rf"(?:{BEFORE}(?:{DOT_WORDS}|\.){AFTER}|{GAP}dot{GAP})"
# An address in words: without a bracket both the at and a dot must be written out.
ADDRESS = re.compile(
    rf"(?P<at>{BEFORE}(?:{AT_WORDS}|@){AFTER})(?={LABEL}(?:\.|{DOT}){LABEL})"
    rf"|(?P<bare>(?<=[A-Za-z0-9]){GAP}at{GAP})(?!(?:the|a|an|this|that)\b)(?={LABEL}(?:\.{LABEL})*{DOT}[A-Za-z]{{2,}}\b)"
    rf"|(?P<dot>{DOT})(?=[A-Za-z0-9])",
    re.IGNORECASE,
)
BRACKETED = re.compile(rf"[(\[{{<][ \t]{{0,3}}(?:{AT_WORDS}|{DOT_WORDS}|[@.])", re.IGNORECASE)
NUMBER_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"\b(?:{NUMBER_WORD})(?:[ \t-]+(?:dot[ \t]+)?(?:{NUMBER_WORD})){{{SPELLED_RUN - 1},}}\b", re.IGNORECASE)
SPELLED_PART = re.compile(rf"([ \t-]*)\b(dot|{NUMBER_WORD})\b", re.IGNORECASE)
PLUS = re.compile(rf"\bplus{GAP}(?=\d)", re.IGNORECASE)


@lru_cache(maxsize=1 << 16)
def plain_form(char: str) -> str | None:
    """The ASCII text that a character above ASCII stands for, or None where it is none of a pattern's."""
    if char in INVISIBLE:
        return ""
    if char in DASHES:
        return "-"
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", char)
    return form if form.isascii() and len(form) == 1 else None


WORD = re.compile(r"[^ \t\n\r]+")
# Characters beyond the Latin blocks, and blanks and hyphens that do not show.
EXOTIC = re.compile(r"[^\x00-\u024f\u1e00-\u1eff]|[\u00a0\u00ad]")

Edit = tuple[int, int, str]


def look_alike_edits(text: str) -> list[Edit]:
    """Characters that look like ASCII ones; a letter only in a word that holds an ASCII letter or digit, or ``@``.

    A word in Cyrillic or Greek alone stays as it is.
    """
    edits: list[Edit] = []
    for word in WORD.finditer(text):
        chars = word.group()
        if not EXOTIC.search(chars):
            continue
        mixed = any(c.isascii() and (c.isalnum() or c == "@") for c in chars)
        for k, char in enumerate(chars, word.start()):
            form = None if char.isascii() else plain_form(char)
            if form is not None and (mixed or char not in LOOK_ALIKES):
                edits.append((k, k + 1, form))
    return edits


def spelled_edits(text: str) -> list[Edit]:
    """Runs of ``SPELLED_RUN`` or more digits in words, with ``dot`` between them as a point."""
    edits: list[Edit] = []
    for run in SPELLED.finditer(text):
        for part in SPELLED_PART.finditer(text, run.start(), run.end()):
            word = part.group(2).lower()
            start = part.start() if part.start() > run.start() else part.start(2)
            edits.append((start, part.end(), "." if word == "dot" else DIGITS[word]))
    return edits


def address_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "." if m.lastgroup == "dot" else "@") for m in ADDRESS.finditer(text)]


def plus_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "+") for m in PLUS.finditer(text)]


class Rewritten:
    """A text after some transducers, with the source stretch of every changed one.

    ``changed`` lists stretches of the present text by their start: (start, end, source start,
    source end). Text between them is the source's own, character by character.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.changed: list[tuple[int, int, int, int]] = []

    def source(self, position: int, ending: bool) -> int:
        """Where a position lies in the source: within a changed stretch, at its start or its end."""
        k = bisect_right(self.changed, position - ending, key=lambda c: c[0]) - 1
        if k < 0:
            return position
        start, end, low, high = self.changed[k]
        if position - ending < end:
            return high if ending else low
        return position - end + high

    def touched(self, start: int, end: int) -> bool:
        k = bisect_right(self.changed, end - 1, key=lambda c: c[0]) - 1
        while k >= 0 and self.changed[k][1] >= start:
            low, high = self.changed[k][:2]
            if high > start or (low == high and start < low < end):
                return True
            k -= 1
        return False

    def apply(self, edits: list[Edit]) -> None:
        """Replace stretches of the present text, given in order and apart; those of earlier edits merge into them."""
        if not edits:
            return
        parts: list[str] = []
        changed: list[tuple[int, int, int, int]] = []
        old = 0
        done = shift = 0
        for start, end, form in edits:
            while old < len(self.changed) and self.changed[old][1] <= start:
                a, b, low, high = self.changed[old]
                changed.append((a + shift, b + shift, low, high))
                old += 1
            while old < len(self.changed) and self.changed[old][0] < end:
                old += 1
            parts += [self.text[done:start], form]
            changed.append((start + shift, start + shift + len(form), self.source(start, False), self.source(end, True)))
            shift += len(form) - (end - start)
            done = end
        for a, b, low, high in self.changed[old:]:
            changed.append((a + shift, b + shift, low, high))
        parts.append(self.text[done:])
        self.text = "".join(parts)
        self.changed = changed


def rewritten(text: str) -> Rewritten:
    """The text with all disguises undone; unchanged texts, nearly all, cost one pass of each search."""
    form = Rewritten(text)
    if EXOTIC.search(text):
        form.apply(look_alike_edits(text))
    form.apply(spelled_edits(form.text))
    form.apply(plus_edits(form.text))
    if BRACKETED.search(form.text) or " dot " in form.text.lower():
        form.apply(address_edits(form.text))
    return form


# Character classes of the plain patterns.
def byte_class(chars: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(chars)] = True
    return held


FIGURES = b"0123456789"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGIT = byte_class(FIGURES)
LOCAL = byte_class(LETTERS + FIGURES + b"._%+-")
DOMAIN = byte_class(LETTERS + FIGURES + b"-")
DIALLED = byte_class(FIGURES + b" ().-")
MOST_PART = 255
CARD_DIGITS = range(14, 20)
PHONE_DIGITS = range(10, 16)

Span = tuple[int, int, int]


def run_ends(held: np.ndarray) -> np.ndarray:
    """For each position the end of the run of held ones from there, the position itself where it is not held."""
    n = len(held)
    stop = np.where(held, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1]


def digit_runs(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of digits, none over the edge of two texts."""
    held = DIGIT[raw]
    begins, stops = held.copy(), held.copy()
    begins[1:] &= ~held[:-1]
    stops[:-1] &= ~held[1:]
    begins[edges] = held[edges]
    stops[edges - 1] = held[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def chains(starts: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and one past the last of the runs that are joined one to the next, of two runs or more."""
    inner = np.concatenate([[False], joined, [False]])
    begins = np.flatnonzero(~inner[:-1] & inner[1:])
    stops = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    yield from zip(begins.tolist(), stops.tolist())


def passes_luhn(digits: np.ndarray) -> bool:
    values = digits[::-1].astype(np.int64) - 48
    values[1::2] *= 2
    return int((values - 9 * (values > 9)).sum()) % 10 == 0


def emails(raw: np.ndarray, offsets: np.ndarray) -> Iterator[Span]:
    ats = np.flatnonzero(raw == ord("@"))
    if not len(ats):
        return
    domain, n = run_ends(DOMAIN[raw]), len(raw)
    outside = np.where(LOCAL[raw], -1, np.arange(n))
    before = np.maximum.accumulate(outside)
    last = 0
    for at in ats.tolist():
        k = int(np.searchsorted(offsets, at, side="right"))
        low, high = int(offsets[k - 1]), int(offsets[k])
        start = max(low, last, int(before[at - 1]) + 1 if at else 0)
        end = min(int(domain[at + 1]), high) if at + 1 < high else at + 1
        labels = 1
        if end > at + 1:
            while end + 1 < high and raw[end] == ord(".") and domain[end + 1] > end + 1:
                end = min(int(domain[end + 1]), high)
                labels += 1
        if start < at and labels > 1:
            yield 0, start, end
            last = end


def addresses(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> Iterator[Span]:
    joined = (starts[1:] == ends[:-1] + 1) & (raw[np.minimum(ends[:-1], len(raw) - 1)] == ord(".")) & ~np.isin(starts[1:], edges) & ~np.isin(ends[:-1], edges)
    for first, stop in chains(starts, joined):
        for k in range(first, stop - 3, 4):
            parts = [raw[starts[j] : ends[j]].tobytes().lstrip(b"0") for j in range(k, k + 4)]
            if all(len(p) <= 3 and int(p or b"0") <= MOST_PART for p in parts):
                yield 1, int(starts[k]), int(ends[k + 3])


def cards(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> Iterator[Span]:
    mark = raw[np.minimum(ends[:-1], len(raw) - 1)]
    joined = (starts[1:] == ends[:-1] + 1) & ((mark == ord(" ")) | (mark == ord("-"))) & ~np.isin(starts[1:], edges) & ~np.isin(ends[:-1], edges)
    inner = np.concatenate([[False], joined])
    head = np.flatnonzero(~inner)
    tail = np.append(head[1:], len(starts)) - 1
    size = np.add.reduceat(ends - starts, head)
    for a, b in zip(head[(size >= CARD_DIGITS[0]) & (size <= CARD_DIGITS[-1])], tail[(size >= CARD_DIGITS[0]) & (size <= CARD_DIGITS[-1])]):
        whole = raw[starts[a] : ends[b]]
        if passes_luhn(whole[DIGIT[whole]]):
            yield 2, int(starts[a]), int(ends[b])


def phones(raw: np.ndarray, offsets: np.ndarray) -> Iterator[Span]:
    pluses = np.flatnonzero(raw == ord("+"))
    pluses = pluses[DIGIT[raw[np.minimum(pluses + 1, len(raw) - 1)]]]
    if not len(pluses):
        return
    dialled = run_ends(DIALLED[raw])
    for plus in pluses.tolist():
        high = int(offsets[np.searchsorted(offsets, plus, side="right")])
        if plus + 1 >= high:
            continue
        run = raw[plus + 1 : min(int(dialled[plus + 1]), high)]
        figures = np.flatnonzero(DIGIT[run])
        if figures[-1] >= 2 and len(figures) in PHONE_DIGITS:
            yield 3, plus, plus + 2 + int(figures[-1])


def plain_spans(raw: np.ndarray, offsets: np.ndarray) -> list[Span]:
    """(kind, start, end) in bytes of all plain identifiers of the texts between ``offsets``."""
    if not len(raw):
        return []
    found = [*emails(raw, offsets), *phones(raw, offsets)]
    inner = offsets[1:-1]
    edges = np.unique(inner[(inner > 0) & (inner < len(raw))])
    starts, ends = digit_runs(raw, edges)
    if len(starts):
        found += [*addresses(raw, starts, ends, edges), *cards(raw, starts, ends, edges)]
    return found


def text_spans(text: str) -> list[Span]:
    """The plain identifiers of one text, in characters."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    found = plain_spans(raw, np.array([0, len(raw)]))
    return in_characters(raw, np.array([0, len(raw)]), found)[0] if found else []


def in_characters(raw: np.ndarray, offsets: np.ndarray, found: list[Span]) -> list[list[Span]]:
    """The spans of each text, counted in its characters, by start and kind."""
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    by_text: list[list[Span]] = [[] for _ in range(len(offsets) - 1)]
    for kind, start, end in sorted(found, key=lambda s: (s[1], s[0])):
        k = int(np.searchsorted(offsets, start, side="right")) - 1
        zero = chars[offsets[k]]
        by_text[k].append((kind, int(chars[start] - zero), int(chars[end] - zero)))
    return by_text


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show only once disguises are undone, as source spans; none that a plain one covers."""
    form = rewritten(text)
    if not form.changed:
        return []
    added = []
    for kind, start, end in text_spans(form.text):
        if form.touched(start, end):
            span = kind, form.source(start, False), form.source(end, True)
            if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in plain):
                added.append(span)
    return added


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id and ``found``, its identifiers: ``kind, start, stop, plain``, by start and kind.

    Positions count characters, ``stop`` is one past the last. ``plain`` spans match the patterns as
    the text stands; the others are seen once disguises are undone. A plain span is never changed or
    dropped. A null or empty text has none. Row per row: repeated rows and null ids pass through,
    other columns are not read, an empty table stays empty. No shuffle; a task holds a slice of
    texts, and a very long text alone.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    fields = [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("plain", pa.bool_())]
    spans_type = pa.list_(pa.struct(fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                raw, offsets = byte_view(batch.column("_text"))
                rows = []
                for text, plain in zip(batch.column("_text").to_pylist(), in_characters(raw, offsets, plain_spans(raw, offsets))):
                    spans = [(s, k, e, True) for k, s, e in plain] + [(s, k, e, False) for k, s, e in disguised_spans(text or "", plain)]
                    rows.append([{"kind": KINDS[k], "start": s, "stop": e, "plain": p} for s, k, e, p in sorted(spans)])
                yield pa.record_batch([batch.column("_id"), pa.array(rows, spans_type)], names=["_id", "found"])

    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = rows.mapInArrow(work, f"_id {kind}, found array<struct<kind:string,start:long,stop:long,plain:boolean>>")
    return made.select(F.col("_id").alias(id_col), "found")
