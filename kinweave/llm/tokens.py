"""Encoding a corpus with a public byte-level BPE vocabulary.

The encoder is a streaming transducer. A text is read in blocks that end where a word certainly ends; inside a word
the tokens of every prefix form a tree: the last token of a prefix is the one token that ends there and is compatible
with the last token of the prefix before it. No token is longer than the vocabulary's longest one, so every later
prefix goes through one of that many positions: that is the lookahead that suffices. A token is given out once the
paths of all those positions share it, so the memory in use doesn't grow with the word.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16_000_000
#: How the vocabulary's authors cut text into words before merging.
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_WORD_END = regex.compile(r"(?r)(?<=\P{White_Space})\p{White_Space}")
BLOCK = 65_536
CACHED_WORDS = 150_000
SHORT = 48


class Transducer:
    def __init__(self, vocabulary: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.word = {i: b for b, i in self.rank.items()}
        self.lookahead = max(map(len, self.rank))
        self.tails = {t[i:] for t in self.rank for i in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; for two tokens or short words."""
        rank, parts = self.rank, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            known = self.fits[key] = self._merge(self.word[a] + self.word[b]) == [a, b]
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one word whose bytes come in chunks, each given out as soon as it is stable."""
        rank, word, tails, most = self.rank, self.word, self.tails, self.lookahead
        data, last = b"", [-1]  # bytes since the last stable cut, and the last token of each prefix of them
        before = -1  # the token before the stable cut
        for chunk in chunks:
            data += chunk
            while len(last) <= len(data):
                i = len(last)
                n, found = 1, -1
                while n <= i and (tail := data[i - n : i]) in tails:
                    r = rank.get(tail)
                    if r is not None:
                        prev = last[i - n] if n < i else before
                        if (n == i and before < 0) or (prev >= 0 and self._compatible(prev, r)):
                            found = r
                            break
                    n += 1
                last.append(found)
                if i >= 4 * most and i % most == 0:
                    cut, ids = self._stable(last, i)
                    if cut:
                        yield from ids
                        before, data = ids[-1], data[cut:]
                        last = [-1, *last[cut + 1 :]]
        path, i = [], len(data)
        while i:
            path.append(last[i])
            i -= len(word[last[i]])
        yield from reversed(path)

    def _stable(self, last: list[int], i: int) -> tuple[int, list[int]]:
        """The furthest cut that the paths of all live positions share, and the tokens up to it."""
        common = None
        for j in range(i - self.lookahead + 1, i + 1):
            if last[j] < 0:
                continue
            cuts, at = set(), j
            while at > 0 and last[at] >= 0:
                cuts.add(at)
                at -= len(self.word[last[at]])
            if at == 0:
                common = cuts if common is None else common & cuts
        if not common:
            return 0, []
        cut = max(common)
        ids, at = [], cut
        while at > 0:
            ids.append(last[at])
            at -= len(self.word[last[at]])
        return cut, ids[::-1]

    def encode_word(self, w: str) -> list[int]:
        data = w.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= SHORT:
            return list(self.stream((data,)))
        return list(self.stream(data[k : k + BLOCK] for k in range(0, len(data), BLOCK)))

    def encode(self, text: str) -> list[int]:
        cache, out = self.cache, []
        for block in blocks(text):
            for w in WORDS.findall(block):
                ids = cache.get(w)
                if ids is None:
                    ids = self.encode_word(w)
                    if len(w) <= SHORT:
                        if len(cache) >= CACHED_WORDS:
                            cache.clear()
                        cache[w] = ids
                out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of token ids by an incremental UTF-8 state machine; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [machine.decode(self.word[i]) for i in ids]
        parts.append(machine.decode(b"", True))
        return "".join(parts)


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in blocks that end between a word and a blank: no word, and no run of blanks, is cut."""
    at, n = 0, len(text)
    while n - at > size:
        end = at + size
        m = _WORD_END.search(text, at + 1, end)
        while m is None and end < n:
            end = min(n, end + size)
            m = _WORD_END.search(text, at + 1, end)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < n:
        yield text[at:]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be to be sent to every executor")
    return data


@lru_cache(maxsize=2)
def _transducer(vocabulary: bytes) -> Transducer:
    return Transducer(vocabulary)


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with a column of token ids, without special tokens. Empty and NULL texts have the empty list."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # of a checked size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(shared.value)
        for s in batches:
            yield pd.Series([np.array(t.encode(x), dtype=np.int32) if x else np.empty(0, np.int32) for x in s])

    return spread(docs).withColumn(into, F.pandas_udf(run, "array<int>")(F.col(text)))


def count_tokens(docs: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the number of tokens; 0 for empty and NULL texts."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(shared.value)
        for s in batches:
            yield pd.Series([len(t.encode(x)) if x else 0 for x in s], dtype="int64")

    return spread(docs).withColumn(into, F.pandas_udf(run, "long")(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", into: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text of its token ids; NULL ids give NULL."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(shared.value)
        for s in batches:
            yield pd.Series([None if x is None else t.decode(x) for x in s])

    return df.withColumn(into, F.pandas_udf(run, "string")(F.col(ids)))
