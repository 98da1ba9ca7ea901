"""URL verdicts from a bit-parallel wildcard automaton.

Every rule becomes a glob over the canonical URL, which is ``.host``, a mark, then the path.
All globs share one bit string: a pattern of n symbols holds n + 1 neighbouring bits, the first
being its start. One step per symbol moves all patterns of all URLs of a batch at once:

    D' = (D << 1 & B[symbol]) | (D & S)

``B[symbol]`` has the bits that the symbol may enter, ``S`` the bits that a ``*`` keeps alive.
The bit string spans as many 64-bit words as the patterns need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\0"
"""Stands between host and path in a pattern; in a URL it is a symbol of its own, so no text can forge it."""

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
"""Host and all its subdomains, path prefix, verdict. The longest fitting rule wins."""

BLOCKED_GLOBS = (
    "*spam-farm*",
    "*cheap-pills*",
    "*free-casino*",
    "*.doubleclick.*",
    "*/wp-login.php*",
    "*/cgi-bin/*",
    "*?xxx.*",
)
"""Globs over ``.host`` + path for URLs that no rule fits: ``*`` any run, ``?`` one symbol."""

SEPARATOR_CODE, OTHER_CODE = 0, 1
ROWS = 4096


@dataclass(frozen=True)
class Automaton:
    codes: dict[int, int]
    enter: np.ndarray
    keep: np.ndarray
    start: np.ndarray
    accept: tuple[tuple[int, int], ...]
    """Word and bit of each pattern's last state, by pattern."""


def rule_glob(host: str, path: str) -> str:
    return f"*.{host.lower()}{MARK}{path}*"


def compile_globs(globs: list[str]) -> Automaton:
    """Pack the globs into one bit string. An empty glob fits the empty URL only."""
    literal = sorted({ord(c) for g in globs for c in g if c not in f"*?{MARK}"})
    codes = {c: k + 2 for k, c in enumerate(literal)}
    total = sum(sum(c != "*" for c in g) + 1 for g in globs)
    words = max(1, -(-total // 64))
    enter = np.zeros((len(codes) + 2, words), np.uint64)
    keep, start = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    accept, at = [], 0

    def put(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    for glob in globs:
        put(start, at)
        for c in glob:
            if c == "*":
                put(keep, at)
                continue
            at += 1
            if c == "?":
                for row in enter[1:]:
                    put(row, at)
            else:
                put(enter[SEPARATOR_CODE if c == MARK else codes[ord(c)]], at)
        accept.append((at // 64, at % 64))
        at += 1
    return Automaton(codes, enter, keep, start, tuple(accept))


def run(automaton: Automaton, urls: list[tuple[str, str]]) -> np.ndarray:
    """Which pattern fits which (host, path): a boolean matrix, URLs by patterns."""
    texts = [f".{host}{MARK}{path}" for host, path in urls]
    marks = np.array([len(host) + 1 for host, _ in urls])
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    symbols = np.frombuffer("".join(texts[k] for k in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
    known = np.array(sorted(automaton.codes), np.uint32)
    if len(known):
        place = np.minimum(np.searchsorted(known, symbols), len(known) - 1)
        coded = np.where(known[place] == symbols, place + 2, OTHER_CODE).astype(np.int32)
    else:
        coded = np.full(len(symbols), OTHER_CODE, np.int32)
    coded[base + marks[order]] = SEPARATOR_CODE
    state = np.repeat(automaton.start[None, :], len(texts), axis=0)
    one, top = np.uint64(1), np.uint64(63)
    ordered = lengths[order]
    live = len(texts)
    for step in range(int(ordered[0]) if len(ordered) else 0):
        while ordered[live - 1] <= step:
            live -= 1
        now = state[:live]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        moved &= automaton.enter[coded[base[:live] + step]]
        moved |= now & automaton.keep
        state[:live] = moved
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    fits = [(state[:, w] >> np.uint64(b)) & one for w, b in automaton.accept]
    return np.stack(fits, axis=1).astype(bool)[back] if fits else np.zeros((len(texts), 0), bool)


def url_verdicts(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    blocked: tuple[str, ...] = BLOCKED_GLOBS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id, host, path, rule, verdict``, one row per input row.

    The longest fitting rule gives the verdict; without one, a fitting glob of ``blocked`` gives
    ``block`` and everything else ``allow``. Rules of equal length: the first listed wins. A null
    URL or one without ``://`` has empty host and path, no rule, and is judged by the globs like
    any other. Null ids and repeated rows pass through; other columns are not read, so their names
    cannot clash. An empty table gives an empty result. No shuffle: each batch is judged where it
    is read, and a URL of any length is read to its end.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    after = F.when(F.locate("://", url) > 0, F.expr(f"substring({_text(url_col)}, locate('://', {_text(url_col)}) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract("_after", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select(F.col(id_col).alias("_id"), after.alias("_after")).select(
        F.col("_id"), host.alias("host"), F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1).alias("path")
    )
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    globs = [rule_glob(h, p) for h, p, _ in ordered] + list(blocked)
    names = np.array([h + p for h, p, _ in ordered] + [None], object)
    verdicts = np.array([v for _, _, v in ordered] + ["allow"], object)
    automaton = compile_globs(globs)
    n_rules = len(ordered)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                fits = run(automaton, list(zip(hosts, paths)))
                ruled = np.concatenate([fits[:, :n_rules], np.ones((len(hosts), 1), bool)], axis=1).argmax(axis=1)
                spam = fits[:, n_rules:].any(axis=1) & (ruled == n_rules)
                verdict = np.where(spam, "block", verdicts[ruled])
                yield pa.record_batch(
                    [batch.column("_id"), batch.column("host"), batch.column("path"), pa.array(names[ruled], pa.string()), pa.array(verdict, pa.string())],
                    names=[id_col, "host", "path", "rule", "verdict"],
                )

    kind = pages.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _text(name: str) -> str:
    return f"coalesce(`{name}`, '')"
