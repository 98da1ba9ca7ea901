"""Byte-pair encoding of whole texts over a trie of their distinct words, and decoding.

For a word's prefix the last token of its encoding is enough to know the rest: before the last
token stands the encoding of the shorter prefix. A token can end a prefix when it and the last
token of what stands before it encode, joined, to just these two. So one state per trie node
suffices, and words that share a prefix share the states along it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.frames import slices

WORD_END = "</w>"
CACHED_WORDS = 300_000
CACHED_PAIRS = 1_000_000
SLICE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Encodes words given as strings of letters; reads the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.vocab)
        # What the model reaches by merging; a vocabulary entry that no merge makes can never be a result.
        made = {a + b for a, b in pairs} | {t for t in self.vocab if len(t.removesuffix(WORD_END)) == 1}
        self.inner = {t: i for t, i in self.vocab.items() if t in made and not t.endswith(WORD_END)}
        self.final = {t.removesuffix(WORD_END): i for t, i in self.vocab.items() if t in made and t.endswith(WORD_END)}
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(splitter["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.letters = byte_letters()
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first, until no pair has a rank."""
        rank, high = self.rank, len(self.rank)
        while len(symbols) > 1:
            ranks = [rank.get(p, high) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == high:
                break
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def joins(self, left: int, right: int) -> bool:
        """Whether the two tokens, joined, encode to just these two."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            a, b = self.tokens[left], self.tokens[right]
            end = b.endswith(WORD_END)
            symbols = [*a, *b.removesuffix(WORD_END)]
            if end:
                symbols[-1] += WORD_END
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(symbols) == [a, b]
        return found

    def last_token(self, word: str, end: int, tokens: dict[str, int], last: list[int], start: list[int]) -> tuple[int, int]:
        """The last token of ``word[:end]`` and where it begins, given the states of shorter prefixes."""
        for begin in range(max(0, end - self.longest), end):
            token = tokens.get(word[begin:end])
            if token is not None and (not begin or self.joins(last[begin], token)):
                return token, begin
        raise ValueError(f"no token ends {word[:end]!r}")

    def traverse(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Every distinct word with its ids: a depth-first walk of the words' trie.

        Sorted words visit the trie's nodes in depth-first order; ``last`` and ``start`` hold the
        states along the current path, and only nodes that the previous word does not share are
        computed.
        """
        last, start, path = [0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word)):
                token, begin = self.last_token(word, end, self.inner, last, start)
                last.append(token)
                start.append(begin)
            path = word[:-1]
            token, at = self.last_token(word, len(word), self.final, last, start)
            ids = [token]
            while at:
                ids.append(last[at])
                at = start[at]
            yield word, tuple(ids[::-1])

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text after normalisation, and the ids of special tokens it spells out."""
        found: list[str | int] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normal = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                found += self.pattern.findall(normal.lower())
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.pieces(t) for t in texts]
        fresh = {w for pieces in split for w in pieces if w.__class__ is str} - self.known.keys()
        if len(self.known) + len(fresh) > CACHED_WORDS:
            self.known.clear()
            fresh = {w for pieces in split for w in pieces if w.__class__ is str}
        letters = self.letters
        spelled = {(w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()])): w for w in fresh}
        known = self.known
        for spelling, ids in self.traverse(list(spelled)):
            known[spelled[spelling]] = ids
        for i in self.special.values():
            known[i] = (i,)
        return [list(chain.from_iterable([known[p] for p in pieces])) for pieces in split]

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by one space, as a tokenizer without a decoder gives them."""
        return " ".join([self.tokens[i] for i in ids])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


OUTPUTS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}


def encoded(
    documents: DataFrame,
    path: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document's id and the asked ``outputs`` of encoding its whole text and decoding it again.

    ``ids`` are the token ids, ``decoded`` the text that the ids give back; the digests are SHA-256
    of the ids as little-endian 32-bit numbers and of the decoded text. A null or empty text has no
    tokens and decodes to the empty text. Row per row: nulls, ties and repeated rows pass through,
    other columns are not read, an empty table stays empty. ``path`` is the tokenizer file, which
    every executor must have. No shuffle; a task holds a slice of texts and at most
    ``CACHED_WORDS`` known words.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            for batch in slices(whole, text_col, SLICE_BYTES):
                rows = coder.encode([t or "" for t in batch.column(text_col).to_pylist()])
                made: dict[str, list] = {name: [] for name in outputs}
                for ids in rows:
                    text = coder.decode(ids) if "decoded" in made or "decoded_sha256" in made else ""
                    for name, column in made.items():
                        if name == "n_tokens":
                            column.append(len(ids))
                        elif name == "ids":
                            column.append(ids)
                        elif name == "decoded":
                            column.append(text)
                        elif name == "ids_sha256":
                            column.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                        else:
                            column.append(hashlib.sha256(text.encode()).hexdigest())
                arrays = [pa.array(column, OUTPUTS[name]) for name, column in made.items()]
                yield pa.record_batch([batch.column(id_col), *arrays], names=[id_col, *made])

    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} {names[n]}" for n in outputs)])
    return documents.select(id_col, text_col).mapInArrow(work, schema)
