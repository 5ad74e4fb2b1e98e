"""Problem 6: encoding of all texts by byte_bpe_50k.

A text is cut by the tokenizer's public pattern, and each word's ids are found by a backtracking
encoder: an Aho-Corasick automaton of all tokens gives the longest token that starts at each
byte; a token may follow another only if merging the two tokens' bytes by the ranks gives
these two tokens back (the pair-compatibility table, filled as pairs are met); where no token is
compatible, the encoder steps back and takes the next shorter one. The result is the same as by
successive merges, in linear time. Ids of words are kept, as words repeat.

Decoding joins the tokens' bytes from one buffer with an offset table.

Null and empty texts give an empty list. Strings of special tokens are ordinary text. Texts are
encoded whole, whatever their length; copies are encoded each. Columns other than the two named
are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Words whose ids are kept per worker; beyond, the store starts again. It never changes a result.
KEPT_WORDS = 400_000
#: The same for pairs of tokens.
KEPT_PAIRS = 1_000_000
_KEEP_UNDER = 64
#: Ids in one batch of rows.
MOST_IDS = 1 << 28


# The public pattern, and what it is on ASCII texts, in the faster syntax of `re`.
PUBLIC_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Maps a word to its ids. Made once per worker from the file's bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__()
        self.any_words = regex.compile(pattern).findall
        self.ascii_words = re.compile(ASCII_PATTERN).findall if pattern == PUBLIC_PATTERN else self.any_words
        self.tokens = [b""] * (1 + max(int(line.split()[1]) for line in ranks.splitlines() if line))
        for line in ranks.splitlines():
            if line:
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in self.ids.items():
            automaton.add_word(token.decode("latin-1"), i)
        automaton.make_automaton()
        self.matches = automaton.iter
        # the longest proper prefix of each token that is a token
        self.shorter = [-1] * len(self.tokens)
        for token, i in self.ids.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := self.ids.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.parts = self._merges()
        self.pairs: dict[int, bool] = {}
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = b"".join(self.tokens)

    def _merges(self) -> list[tuple[int, int] | None]:
        """The pair of tokens whose merge makes each token; None for single bytes."""
        parts: list[tuple[int, int] | None] = [None] * len(self.tokens)
        for i, token in enumerate(self.tokens):
            if len(token) > 1:
                units = self._merged(token, i)
                if len(units) == 2:
                    parts[i] = (units[0], units[1])
        return parts

    def _merged(self, token: bytes, below: int) -> list[int]:
        """Successive merges by tokens of a lower rank than `below`."""
        units = [token[k : k + 1] for k in range(len(token))]
        while len(units) > 1:
            rank, at = min((self.ids.get(units[k] + units[k + 1], below), k) for k in range(len(units) - 1))
            if rank >= below:
                break
            units[at : at + 2] = [units[at] + units[at + 1]]
        return [self.ids[u] for u in units]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of the two tokens leaves exactly these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo both tokens' merges, latest first: at each step, a merge across the border that
        # ranks before the undone one would have come first.
        limit = len(self.tokens)
        while True:
            across = self.ids.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                if self.parts[left] is None:
                    limit = right + 1
                    if self.parts[right] is None:
                        return True
                    limit = right
                    right = self.parts[right][0]
                    if right + 1 > limit:
                        return True
                else:
                    left = self.parts[left][1]
                    if left >= limit:
                        return True
            else:
                limit = right + 1
                if self.parts[right] is None:
                    limit = left
                    if self.parts[left] is None:
                        return True
                    left = self.parts[left][1]
                    if left >= limit:
                        return True
                else:
                    right = self.parts[right][0]
                    if right + 1 > limit:
                        return True

    def word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ids.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        longest = [-1] * n
        for end, i in self.matches(word.decode("latin-1")):
            start = end + 1 - len(self.tokens[i])
            if longest[start] < 0 or len(self.tokens[longest[start]]) < len(self.tokens[i]):
                longest[start] = i
        # pyahocorasick gives every match, so longest[start] is the longest token from there
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            if token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                else:
                    token = self.shorter[token]
            else:  # nothing fits here: step back
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.shorter[token]
        return tuple(out)

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.word(word.encode("utf-8", "surrogatepass"))
        if len(word) < _KEEP_UNDER:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        return self.ascii_words(text) if text.isascii() else self.any_words(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.words(text)))) if text else 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.buffer[self.offsets[i] : self.offsets[i + 1]] for i in ids)


_made: dict[int, Encoder] = {}


def encoder_of(ranks: bytes, pattern: str) -> Encoder:
    key = hash((ranks, pattern))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks, pattern)
    return _made[key]


def _shared(df: DataFrame, path: str | None):
    with open(path or vocabulary_path(), "rb") as file:  # under 1 MB, read by the driver alone
        return df.sparkSession.sparkContext.broadcast((file.read(), PUBLIC_PATTERN))


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids)."""
    vocabulary = _shared(texts, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(*vocabulary.value)
        for b in batches:
            lists = [encoder.encode(t) for t in b[text].to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int64)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            start = 0
            while start < len(lists):  # a batch of lists has 32-bit offsets, so that very long ones are parted
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + MOST_IDS, side="right")) - 1)
                values = np.fromiter(chain.from_iterable(lists[start:end]), np.int32, count=int(offsets[end] - offsets[start]))
                part = pa.array((offsets[start : end + 1] - offsets[start]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b[key].slice(start, end - start), pa.ListArray.from_arrays(part, pa.array(values))], names=[key, "ids"])
                start = end

    from pyspark.sql.types import StructField, StructType

    return texts.select(key, text).mapInArrow(run, StructType([texts.schema[key], StructField("ids", ArrayType(IntegerType()))]))


def token_count(text: Column, df: DataFrame, path: str | None = None) -> Column:
    """Number of ids of a text, 0 for a null one."""
    vocabulary = _shared(df, path)

    def count(values: pa.Array) -> pa.Array:
        encoder = encoder_of(*vocabulary.value)
        return pa.array([encoder.count(t) for t in values.to_pylist()], pa.int32())

    count.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, IntegerType())(text)
