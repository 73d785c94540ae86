"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

``BytePairs`` holds the merge list of a public byte-level BPE vocabulary.  ``lookahead`` is computed
from the merges: the number of bytes to the right of a token boundary that can still move it.  A
merge at a boundary can be prevented only by an earlier merge that takes a suffix of its right
part, which in turn can be prevented only by an earlier one further right; the longest such chain
bounds the bytes that matter.  ``Transducer`` reads text in pieces of any size, emits the ids of a
pre-token as soon as it has ended, and inside a pre-token that does not end, each token once
``lookahead`` further bytes are known; so its memory does not grow with the text.  ``Utf8Decoder``
turns the bytes of tokens back to text with a state machine that keeps at most one open character.

Defined results: NULL and empty texts have an empty list of ids; strings of special tokens are
ordinary text; repeated rows keep their ids; the vocabulary's path is a parameter.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"
#: the public pre-tokenisation pattern of byte-level BPE (a fixed value)
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: characters after a match that can still change it
_SURE = 3
PIECE = 1 << 16
_CACHED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """Vocabulary and merges of a byte-level BPE file in the format of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        special = [t for t in model["vocab"] if any(c not in letters for c in t)]
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special and not t.startswith("<|")}
        self.tokens = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {m: r for r, m in enumerate(self.merges)}
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a boundary that can still decide about it."""
        if self._lookahead is None:
            made: dict[bytes, bytes] = {}  # token -> its right part in the merge that made it first
            reach: dict[bytes, int] = {}  # token -> longest chain of merges so far that starts with it on the left
            longest = 1
            for left, right in self.merges:
                chain = 0
                part: bytes | None = right
                while part is not None:  # suffixes of the right part that an earlier merge can take away
                    chain = max(chain, reach.get(part, 0) - len(part))
                    part = made.get(part)
                length = len(left) + len(right) + max(0, chain)
                if length > reach.get(left, 0):
                    reach[left] = length
                made.setdefault(left + right, right)
                longest = max(longest, length)
            self._lookahead = longest
        return self._lookahead

    def split(self, data: bytes) -> list[bytes]:
        """Tokens of one stretch of bytes: merges in order of rank, leftmost first."""
        if data in self.ids and len(data) == 1:
            return [data]
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        if len(parts) <= 48:
            while len(parts) > 1:
                best, at = min((ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if best == 1 << 30:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        n = len(parts)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i] = left + right
            parts[j] = b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            h, k = before[i], after[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
            if k >= 0 and (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        return [p for p in parts if p]


class Transducer:
    """Reads a text in pieces and emits ids that no further piece can change."""

    def __init__(self, pairs: BytePairs, cache: dict[str, tuple[int, ...]] | None = None) -> None:
        self.pairs = pairs
        self.cache = {} if cache is None else cache
        self.text = ""  # characters whose pre-token is not sure
        self.open = b""  # bytes of an open pre-token that are already taken from the text

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            ids = self.pairs.ids
            found = tuple(ids[t] for t in self.pairs.split(word.encode("utf-8", "surrogatepass")))
            if len(word) <= 64:
                if len(self.cache) >= _CACHED:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def _stable(self, final: bool) -> list[int]:
        """Ids of the open pre-token's tokens that are stable; all of them when it has ended."""
        tokens = self.pairs.split(self.open)
        ids = self.pairs.ids
        if final:
            self.open = b""
            return [ids[t] for t in tokens]
        out: list[int] = []
        taken = 0
        limit = len(self.open) - self.pairs.lookahead
        for t in tokens:
            if taken + len(t) > limit:
                break
            taken += len(t)
            out.append(ids[t])
        self.open = self.open[taken:]
        return out

    def feed(self, piece: str, final: bool = False) -> list[int]:
        text = self.text + piece
        out: list[int] = []
        at = 0
        size = len(text)
        window = 2 * self.pairs.lookahead
        if self.open:
            # the first match goes on with the open pre-token: a letter, digit, mark or blank run
            m = PATTERN.match(text)
            end = m.end() if m is not None else 0
            if end and (end + _SURE <= size or final):
                self.open += text[:end].encode("utf-8", "surrogatepass")
                out += self._stable(True)
                at = end
            elif end > window:
                self.open += text[: end - _SURE - 1].encode("utf-8", "surrogatepass")
                out += self._stable(False)
                self.text = text[end - _SURE - 1 :]
                return out
            else:
                self.text = text
                return out
        word = self._word
        cache = self.cache
        for m in PATTERN.finditer(text, at):
            end = m.end()
            if end + _SURE > size and not final:
                break
            w = m.group()
            found = cache.get(w)
            out.extend(word(w) if found is None else found)
            at = end
        rest = text[at:]
        if len(rest) > window + _SURE and not final:
            m = PATTERN.match(rest)
            keep = m.end() - _SURE - 1
            self.open = rest[:keep].encode("utf-8", "surrogatepass")
            out += self._stable(False)
            rest = rest[keep:]
        self.text = rest
        return out

    def finish(self) -> list[int]:
        out = self.feed("", final=True)
        if self.open:
            out += self._stable(True)
        return out


def encode(text: str | None, pairs: BytePairs, cache: dict[str, tuple[int, ...]]) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE:
        return Transducer(pairs, cache).feed(text, final=True)
    transducer = Transducer(pairs, cache)
    out: list[int] = []
    for at in range(0, len(text), PIECE):
        out += transducer.feed(text[at : at + PIECE])
    return out + transducer.finish()


class Utf8Decoder:
    """Bytes to text, a token at a time; invalid bytes become U+FFFD."""

    def __init__(self) -> None:
        self.need = 0
        self.value = 0
        self.least = 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if b & 0xC0 == 0x80:
                    self.value = self.value << 6 | b & 0x3F
                    self.need -= 1
                    if not self.need:
                        good = self.least <= self.value <= 0x10FFFF and not 0xD800 <= self.value <= 0xDFFF
                        out.append(chr(self.value) if good else "�")
                    continue
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xE0:
                self.need, self.value, self.least = 1, b & 0x1F, 0x80
            elif 0xE0 <= b < 0xF0:
                self.need, self.value, self.least = 2, b & 0x0F, 0x800
            elif 0xF0 <= b < 0xF5:
                self.need, self.value, self.least = 3, b & 0x07, 0x10000
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        open_, self.need = self.need, 0
        return "�" if open_ else ""


def decode(ids: list[int], pairs: BytePairs) -> str:
    decoder = Utf8Decoder()
    return "".join([decoder.feed(pairs.tokens[i]) for i in ids]) + decoder.finish()


@lru_cache(maxsize=2)
def load_pairs(path: str) -> BytePairs:
    """One vocabulary for each worker process."""
    return BytePairs(path)


_CACHES: dict[str, dict[str, tuple[int, ...]]] = {}


def encoder(path: str | None = None) -> tuple[BytePairs, dict[str, tuple[int, ...]]]:
    path = path or os.path.join(FOLDER, BYTE_BPE_50K)
    return load_pairs(path), _CACHES.setdefault(path, {})


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, cache = encoder(path)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [encode(t, pairs, cache) for t in part["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """``columns`` and n_tokens of each row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, cache = encoder(path)
        for part in parts:
            yield part[columns].assign(n_tokens=pd.Series([len(encode(t, pairs, cache)) for t in part["text"]], index=part.index, dtype="int64"))

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return docs.select(*columns, F.col("text") if "text" not in columns else F.col("text")).mapInPandas(run, f"{schema}, n_tokens bigint")
