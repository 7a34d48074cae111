"""Byte-level BPE over Spark columns: encoding to ids and decoding back to bytes.

Each text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is a
vocabulary entry is resolved by one probe of a minimal perfect hash; any other is merged
from its bytes by a heap of adjacent pairs over a linked list, lowest rank first and
leftmost among equals. Texts are independent, so nothing is shuffled; a lost executor
costs the tasks it ran.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct pre-tokens that one generation of a task's memory holds; there are two.
MEMO = 60_000
#: Bytes of the longest pre-token that is kept from block to block.
KEPT = 64
#: Pre-tokens in hand at once, so that the memory for one text does not grow with the text.
PIECES = 50_000
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank. Ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    entries = [token for _, token in sorted(pairs)]
    if sorted(rank for rank, _ in pairs) != list(range(len(pairs))) or len(set(entries)) != len(entries):
        raise ValueError(f"{path}: ranks must be distinct, from 0, without gaps")
    if missing := {bytes([b]) for b in range(256)} - set(entries):
        raise ValueError(f"{path}: {len(missing)} single bytes have no rank")
    return entries


def _slot(h: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    """Where a 64-bit hash lands under a displacement: one multiplicative mix of both."""
    with np.errstate(over="ignore"):
        x = (h ^ (np.asarray(displacement).astype(np.uint64) * MIX)) * STEP
        return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n slots.

    Keys fall into n buckets; each bucket, largest first, gets the smallest displacement that
    sends its keys to free slots. A bucket of one key names its slot directly (as a negative
    number), so the last third of the slots needs no search.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        self.buckets = max(1, n)
        self.displacement = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        by_size = np.argsort(starts[:-1] - starts[1:], kind="stable")
        single = []
        for b in by_size.tolist():
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                single += [(b, int(k)) for k in own]
                continue
            lo = 1
            while True:
                tries = _slot(h[own], np.arange(lo, lo + 16)[:, None], n)
                free = (self.key_at[tries] < 0).all(axis=1)
                if (d := next((i for i in np.flatnonzero(free) if len(set(tries[i].tolist())) == len(own)), None)) is not None:
                    break
                lo += 16
            self.key_at[tries[d]], self.displacement[b] = own, lo + d
        for (b, k), slot in zip(single, np.flatnonzero(self.key_at < 0), strict=True):
            self.key_at[slot], self.displacement[b] = k, -int(slot) - 1

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only key number each of ``keys`` can have; the caller compares the bytes."""
        h = self.hashes(keys)
        d = self.displacement[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(d < 0, -d - 1, _slot(h, d, self.n))]


class Codec:
    """Encodes and decodes on one worker; made once there from the broadcast vocabulary."""

    def __init__(self, entries: list[bytes], perfect: PerfectHash, pattern: str):
        self.entries, self.perfect = entries, perfect
        self.find = regex.compile(pattern)
        self.rank = {token: i for i, token in enumerate(entries)}
        self.two = [[self.rank.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, merged from its bytes.

        ``pair[i]`` is the rank of the part at i joined to the next one, -1 for none; heap
        entries hold a rank above a position, and one whose rank is no longer the pair's is stale.
        """
        n, get, push, two = len(piece), self.rank.get, heapq.heappush, self.two
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part runs from i to after[i]
        pair = [two[a][b] for a, b in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i = x & mask
            if pair[i] != x >> bits:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            after[j] = -1
            if k < n:
                before[k] = i
                if (r := get(piece[i : after[k]], -1)) >= 0:
                    pair[i] = r
                    push(heap, r << bits | i)
            if (p := before[i]) >= 0:
                r = pair[p] = get(piece[p:k], -1)
                if r >= 0:
                    push(heap, r << bits | p)
        ids, i = [], 0
        while i < n:
            ids.append(self.rank[piece[i : after[i]]])
            i = after[i]
        return ids

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of all ``pieces``, as the bytes of 32-bit integers; of those that are long, without keeping them."""
        out = {p: self.young[p] for p in pieces if p in self.young}
        new = pieces.difference(out)
        known = {p: self.old[p] for p in new if p in self.old}
        if rest := [p for p in new if p not in known]:
            keys = [p.encode() for p in rest]
            for piece, key, at in zip(rest, keys, self.perfect.find(keys).tolist(), strict=True):
                out[piece] = np.array([at] if self.entries[at] == key else self.merged(key), np.int32).tobytes()
        out |= known
        for piece in new:
            if len(piece) <= KEPT:
                if len(self.young) >= MEMO:
                    self.old, self.young = self.young, {}
                self.young[piece] = out[piece]
        return out

    def forget(self) -> None:
        """Drop what was learned from texts."""
        self.young, self.old = {}, {}

    def blocks(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """The pre-tokens of the texts, some ``PIECES`` at a time: (number of the text, pre-tokens)."""
        block, held = [], 0
        for k, text in enumerate(texts):
            found = (m.group() for m in self.find.finditer(text)) if len(text or "") > PIECES else iter(self.find.findall(text or ""))
            while pieces := list(islice(found, PIECES)):
                block.append((k, pieces))
                held += len(pieces)
                if held >= PIECES:
                    yield block
                    block, held = [], 0
        yield block

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many ids each text has."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for block in self.blocks(texts):
            known = self.learn(set().union(*(pieces for _, pieces in block)))
            for k, pieces in block:
                ids.append(np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32))
                counts[k] += len(ids[-1])
        return np.concatenate([*ids, np.empty(0, np.int32)]), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids. An id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.entries)):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


_codecs: dict[int, Codec] = {}


@contextmanager
def task_memory(own: Codec) -> Iterator[None]:
    """What a task has learned and Arrow has set aside goes with the task; workers live longer."""
    try:
        yield
    finally:
        own.forget()
        pa.default_memory_pool().release_unused()


def codec(key: int, shared: Broadcast) -> Codec:
    """This worker's codec for a broadcast vocabulary, kept from task to task; another vocabulary replaces it."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value)
    return _codecs[key]


class Tokenizer:
    """Column expressions for one rank file. The vocabulary is broadcast: its size is that of the file.

    A null text counts as empty and gives no ids; null ids give null bytes; no rows give none. Every text is
    encoded whole, whatever its length, and its blocks are bounded. Rows, ties and extra
    columns play no part: each value is mapped alone.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        entries = read_ranks(path)
        shared = spark.sparkContext.broadcast((entries, PerfectHash(entries), pattern))
        key = xxhash.xxh3_64_intdigest(b"\n".join(map(base64.b64encode, [*entries, pattern.encode()])))

        def lists_of(texts: pa.Array, own: Codec) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            ids, counts = own.encode(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), ids, ends

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task_memory(own := codec(key, shared)):
                for texts in batches:
                    yield lists_of(texts, own)[0]

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task_memory(own := codec(key, shared)):
                for lists in batches:
                    yield pa.array([own.decode(x.values.to_numpy()) if x.is_valid else None for x in lists], pa.binary())

        @F.arrow_udf("ids array<int>, data binary")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with task_memory(own := codec(key, shared)):
                for texts in batches:
                    lists, ids, ends = lists_of(texts, own)
                    data = pa.array([own.decode(ids[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                    yield pa.StructArray.from_arrays([lists, data], ["ids", "data"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: str | Column) -> Column:
        """Ids of a text, as ``array<int>``."""
        return self._encode(text)

    def decode(self, ids: str | Column) -> Column:
        """Bytes of ``array<int>`` ids."""
        return self._decode(ids)

    def both(self, text: str | Column) -> Column:
        """struct(ids, data): the ids of a text and the bytes decoded from them, in one pass through Python."""
        return self._both(text)


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text``. A column of that name is replaced."""
    return df.withColumn(ids, Tokenizer(df.sparkSession, path, pattern).encode(F.col(f"`{text}`")))


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids``. A column of that name is replaced."""
    return df.withColumn(data, Tokenizer(df.sparkSession, path, pattern).decode(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: both directions, as digests."""
    tokenizer = Tokenizer(df.sparkSession, path, pattern)
    back = df.select(F.col(f"`{id}`"), tokenizer.both(F.col(f"`{text}`")).alias("both")).select(F.col(f"`{id}`"), "both.*")
    return back.select(
        F.col(f"`{id}`"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
