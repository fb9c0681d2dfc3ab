"""Byte-pair encoding of whole text columns with a public vocabulary.

Each task splits the texts of a batch into words and encodes the words it hasn't met yet all
together: an index maps every mergeable pair to all its positions in the batch, the active ranks
are applied in ascending order, and each merge updates the lists of the pairs it touches.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.session import ship

TOKENIZERS = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into words before any merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PATTERN = regex.compile(WORDS)
#: A worker forgets the words it has encoded once they hold this many characters.
REMEMBERED_CHARS = 30_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token to its id, which is also the rank of its merge."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairMerger:
    """Encodes lists of words by one pass over the ranks that occur in them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def _rank(self, left: int, right: int) -> int:
        """Rank of the pair, or -1."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self.ranks.get(self.token[left] + self.token[right], -1)
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; an empty word has none."""
        ids: list[int] = []
        following: list[int] = []
        before: list[int] = []
        begins: list[int] = []
        index: dict[int, list[int]] = {}
        for word in words:
            begin = len(ids)
            begins.append(begin)
            ids.extend(self.single[b] for b in word)
            end = len(ids)
            before.extend(range(begin - 1, end - 1))
            following.extend(range(begin + 1, end + 1))
            if end > begin:
                before[begin] = following[end - 1] = -1
            for at in range(begin, end - 1):
                rank = self._rank(ids[at], ids[at + 1])
                if rank >= 0:
                    index.setdefault(rank, []).append(at)
        active = list(index)
        heapify(active)
        while active:
            rank = heappop(active)
            for at in sorted(index.pop(rank, ())):
                right = following[at]
                if ids[at] < 0 or right < 0 or self._rank(ids[at], ids[right]) != rank:
                    continue  # an earlier merge took one of the two
                ids[at], ids[right] = rank, -1
                after = following[at] = following[right]
                if after >= 0:
                    before[after] = at
                for place in (before[at], at):
                    neighbour = following[place] if place >= 0 else -1
                    if neighbour < 0:
                        continue
                    new = self._rank(ids[place], ids[neighbour])
                    if new >= 0:
                        if new not in index:
                            index[new] = []
                            heappush(active, new)
                        index[new].append(place)
        ends = [*begins[1:], len(ids)]
        return [[i for i in ids[a:b] if i >= 0] for a, b in zip(begins, ends)]


class Known(dict):
    """The words met so far with their ids, and how many characters they hold."""

    chars = 0


_MERGERS: dict[str, tuple[PairMerger, Known]] = {}


def _merger(path: str) -> tuple[PairMerger, Known]:
    """The vocabulary and the words met so far, once per Python worker."""
    if path not in _MERGERS:
        _MERGERS[path] = (PairMerger(load_ranks(path)), Known())
    return _MERGERS[path]


def encode_batch(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, offsets) of a batch."""
    merger, known = _merger(path)
    split = [_PATTERN.findall(text) if text else [] for text in texts]
    met = set().union(*split)
    new = list(met.difference(known))
    if known.chars + sum(map(len, new)) > REMEMBERED_CHARS:
        known.clear()
        known.chars, new = 0, list(met)
    known.chars += sum(map(len, new))
    known.update(zip(new, merger.encode([word.encode("utf-8", "replace") for word in new])))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    parts = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
    np.cumsum([len(part) for part in parts], out=offsets[1:])
    return np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(offsets[-1])), offsets


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of each row: the ids of its whole text, without special tokens.

    Null and empty texts give an empty list, marks that look like special tokens are ordinary
    text, a null key stays null, repeated rows are encoded each. No row gives no row. Rows stay
    where they are: nothing is shuffled.
    """
    vocabulary = path or os.path.join(TOKENIZERS, VOCABULARY)
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = encode_batch(batch.column(1).to_pylist(), vocabulary)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(encode, "key long, ids array<int>").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with `n_tokens`, as `encode_texts` counts them, in place of the text column.

    All other columns are kept as they are.
    """
    vocabulary = path or os.path.join(TOKENIZERS, VOCABULARY)
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            _, offsets = encode_batch(texts.to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets))], names=[*others, "n_tokens"])

    rows = docs.select(*others, text)
    return rows.mapInArrow(count, T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))
