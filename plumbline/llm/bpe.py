"""Byte-pair encoding of whole columns of text by a public rank file.

Each pretoken's bytes are the leaves of a segment tree. A leaf holds the rank of the pair that starts there together
with its position, an inner node the smaller of its children, so the root is the leftmost pair of lowest rank. A merge
changes three leaves (the merged pair, the one before it, the swallowed one), each with one walk to the root, until no
pair is left that the vocabulary can merge: O(n log n) for a pretoken of n bytes, however long. Trees of equal size are
stacked in one array and step together, so that NumPy works on thousands of pretokens at once.

Defined results: a null and an empty text both give an empty list; the text is not changed (no normalisation, strings
of special tokens are ordinary text). Unpaired surrogates, which Spark strings cannot hold, do not arise.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.session import spread

#: How the vocabulary's makers split text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.iinfo(np.int64).max
#: Pretokens that one worker remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED = 400_000
#: Cells of the stacked trees that are worked on at once.
STACK_CELLS = 1 << 21


def default_vocabulary() -> str:
    """The rank file byte_bpe_50k.tiktoken; PLUMBLINE_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


class PairRanks:
    """A vocabulary as a table of mergeable pairs: (left id, right id) to the id, and rank, of their union."""

    def __init__(self, path: str, pattern: str = SPLIT):
        with open(path, "rb") as f:
            ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.single = np.full(256, -1, np.int64)
        for byte in range(256):
            self.single[byte] = ids[bytes([byte])]
        pairs = {}
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.ranks = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))
        self.split = regex.compile(pattern)
        self.whole = {t.decode("utf-8", "surrogateescape"): r for t, r in ids.items()}
        self.memory: dict[str, list[int]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the vocabulary has no union of the two or a side is missing (negative)."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_stack(self, words: list[bytes], size: int) -> list[list[int]]:
        """Encode words of at most size bytes (a power of two) by one stack of segment trees."""
        count, log = len(words), size.bit_length() - 1
        lengths = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(count), lengths)
        col = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((count, size), -1, np.int64)
        ids[row, col] = self.single[raw]
        place = np.arange(size)
        after = np.where(place + 1 < lengths[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (count, size)).copy()
        tree = np.full((count, 2 * size), NONE, np.int64)
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size - 1) if size > 1 else np.empty((count, 0), np.int64)
        tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, rank * size + place[:-1])
        for level in range(log - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root % size, root // size
            gone = after[live, at]
            ids[live, at] = rank
            ids[live, gone] = -1
            beyond = after[live, gone]
            after[live, at] = beyond
            ahead = before[live, at]
            has_next, has_prev = beyond >= 0, ahead >= 0
            before[live[has_next], beyond[has_next]] = at[has_next]
            right = np.where(has_next, ids[live, np.maximum(beyond, 0)], -1)
            left = np.where(has_prev, ids[live, np.maximum(ahead, 0)], -1)
            own, previous = self.rank(rank, right), self.rank(left, rank)
            updates = ((gone, np.full(len(live), NONE), None), (at, np.where(own == NONE, NONE, own * size + at), None), (ahead, np.where(previous == NONE, NONE, previous * size + ahead), has_prev))
            for leaf, value, where in updates:
                rows = live
                if where is not None:
                    rows, leaf, value = live[where], leaf[where], value[where]
                node = leaf + size
                tree[rows, node] = value
                for _ in range(log):
                    value = np.minimum(value, tree[rows, node ^ 1])
                    node = node >> 1
                    tree[rows, node] = value
            live = live[tree[live, 1] != NONE]
        flat = ids[ids >= 0].tolist()
        ends = np.cumsum((ids >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of new pretokens into the memory."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            known = self.whole.get(word)
            if known is not None:
                self.memory[word] = [known]
            else:
                size = max(2, 1 << (len(word.encode()) - 1).bit_length())
                by_size.setdefault(size, []).append(word)
        for size, group in by_size.items():
            step = max(1, STACK_CELLS // size)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                for word, ids in zip(part, self.merge_stack([w.encode() for w in part], size)):
                    self.memory[word] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        split = [self.split.findall(text) if text else [] for text in texts]
        memory = self.memory
        self.encode_words([w for w in dict.fromkeys(itertools.chain.from_iterable(split)) if w not in memory])
        return [list(itertools.chain.from_iterable(map(memory.__getitem__, words))) for words in split]


_LOADED: dict[tuple[str, str], PairRanks] = {}


def load_ranks(path: str | None = None, pattern: str = SPLIT) -> PairRanks:
    """One table per worker process and rank file."""
    key = (path or default_vocabulary(), pattern)
    if key not in _LOADED:
        _LOADED[key] = PairRanks(*key)
    return _LOADED[key]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _offsets(lists: list[list[int]]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int32))


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key and ids (array of int) of every row; null and empty texts give an empty list. No shuffle, unless the files
    give fewer tasks than there are cores."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            for part in _slices(batch):
                lists = ranks.encode(part.column(1).to_pylist())
                flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32)
                ids = pa.ListArray.from_arrays(_offsets(lists), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text), key).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens of each text (0 for null and empty ones)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            for part in _slices(batch):
                lists = ranks.encode(part.column(0).to_pylist())
                sizes = pa.array(np.fromiter(map(len, lists), np.int64, len(lists)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], sizes], names=[*keep, name])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(text, *keep), keep[0]).mapInArrow(run, f"{kinds}, `{name}` bigint")
