"""Byte-level BPE by speculation: greedy longest match, verified pair by pair.

Merging a pre-token's bytes in order of rank is slow, and greedy longest match from the left is
mostly right. A sequence of tokens is what merging gives exactly if no two neighbours are joined
at their boundary on the way: whenever the last part of the left one and the first part of the
right one exist together, their merge has to come too late. That test sees two tokens only, so
all neighbours of all proposals are tested at once with array operations, and just the pre-tokens
with a failing pair are merged exactly. Texts are independent; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens in hand at once; what is made of them is dropped with them.
PIECES = 1 << 17
#: Distinct words, and bytes of the longest of them, that a task remembers from block to block.
KNOWN, KEPT = 100_000, 64
#: Later than any merge.
NEVER = np.int64(1) << 40
LAST = int(NEVER)
#: A character that no byte of a word becomes.
BETWEEN = chr(256)
#: The longest word, in bytes, that is scanned for the next merge; longer ones use a heap.
SCANNED = 64
#: Words that are merged at once with array operations.
TOGETHER = 1 << 14
#: Characters of a text that are looked up at once.
LOOKED_UP = 1 << 20
# How the library's byte-level pre-tokenizer cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Code points that `regex` knows as letters or numbers and that library, of an earlier Unicode, does not.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_later = np.zeros(sys.maxunicode + 1, bool)
for _span in LATER.split():
    _lo, _, _hi = _span.partition("-")
    _later[int(_lo, 16) : int(_hi or _lo, 16) + 1] = True
_LATER = "".join("-".join(f"\\U{int(c, 16):08x}" for c in span.split("-")) for span in LATER.split())
#: The same pattern for texts that hold such code points, which count as neither letters nor numbers.
CAREFUL = "(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_LATER}]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{_LATER}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{_LATER}]]+")


def has_later(text: str) -> bool:
    """Whether a text holds one of the code points of ``LATER``, which is a look-up for each character."""
    if text.isascii():
        return False
    parts = (text[lo : lo + LOOKED_UP] for lo in range(0, len(text), LOOKED_UP))
    return any(_later[np.frombuffer(part.encode("utf-32-le"), np.uint32)].any() for part in parts)


def byte_chars() -> list[str]:
    """The character that stands for each byte in the file: itself if it prints, else the next one from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens by id, the two parts each was merged from and when, and the tokens that are found in a text as they are."""

    def __init__(self, entries: list[bytes], parts: np.ndarray, born: np.ndarray, special: dict[str, int]):
        self.entries, self.parts, self.born, self.special = entries, parts, born, special

    @classmethod
    def of(cls, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]) -> Vocabulary:
        """From ids, merges by rank, and special tokens. Every token longer than a byte must have one merge, later than its parts'."""
        n = 1 + max([*tokens.values(), *special.values()])
        entries: list[bytes] = [b""] * n
        for token, i in tokens.items():
            entries[i] = token
        for token, i in special.items():
            entries[i] = token.encode()
        parts, born = np.full((n, 2), -1, np.int64), np.full(n, -1, np.int64)
        for rank, (a, b) in enumerate(merges):
            i = tokens[a + b]
            if parts[i, 0] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            parts[i], born[i] = (tokens[a], tokens[b]), rank
        made = born >= 0
        if len(tokens) != made.sum() + 256 or not all(bytes([b]) in tokens for b in range(256)):
            raise ValueError("tokens are the 256 bytes and what merges make of them")
        if (born[parts[made]] >= born[made, None]).any():
            raise ValueError("a merge comes before that of one of its parts")
        return cls(entries, parts, born, special)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizer file of the byte-level BPE kind; a file that asks for more than this module does is an error."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut["use_regex"]
        added = {t["content"]: t["id"] for t in told["added_tokens"] if not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))}
        if not plain or not level or told["normalizer"] or len(added) < len(told["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        byte = {c: b for b, c in enumerate(byte_chars())}
        raw = lambda token: bytes(map(byte.__getitem__, token))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls.of({raw(t): i for t, i in model["vocab"].items() if t not in added}, [(raw(a), raw(b)) for a, b in pairs], added)


class Pairs:
    """Which tokens may stand next to each other, tested for many pairs at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.left, self.right, self.born, self.n = vocabulary.parts[:, 0], vocabulary.parts[:, 1], vocabulary.born, len(vocabulary.entries)
        made = np.flatnonzero(self.born >= 0)
        keys = self.left[made] * self.n + self.right[made]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], self.born[made][order]
        self.sound = self._sound(made)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When ``a`` followed by ``b`` is merged."""
        keys = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER) if len(self.keys) else np.full(len(keys), NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a token and of the next gives just these two (at time ``until``).

        Goes back in time from the whole tokens: ``a`` is the part that ends at the boundary,
        ``b`` the one that begins there, and each lasts until it became part of something. The
        two are merged if their rank comes before either does; of equal ranks the leftmost goes
        first, so ``b`` may end at that very rank. The part made last is undone first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ends = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        a_ends, b_ends = ends, ends + (until is None)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            r = self.rank(a, b)
            joined = (r < a_ends) & (r <= b_ends) if until is None else (r < a_ends) & (r <= b_ends) & (r < ends)
            good[live[joined]] = False
            a_born, b_born = self.born[a], self.born[b]
            go = ~joined & (np.maximum(a_born, b_born) >= 0)
            live, a, b, a_ends, b_ends, ends, a_born, b_born = (x[go] for x in (live, a, b, a_ends, b_ends, ends, a_born, b_born))
            undo = a_born > b_born  # else b, also where both were made by the same merge
            a_ends, b_ends = np.where(undo, a_born, a_ends), np.where(undo, b_ends, b_born)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good

    def _sound(self, made: np.ndarray) -> np.ndarray:
        """Tokens that merging can give: their parts are, and meet at the boundary only when the token is made."""
        own = np.ones(self.n, bool)
        own[made] = self.compatible(self.left[made], self.right[made], self.born[made])
        for i in made[np.argsort(self.born[made])].tolist():
            own[i] &= own[self.left[i]] and own[self.right[i]]
        return own


def packed_ids(ids: Sequence[int]) -> bytes:
    """Ids as the bytes of unsigned 32-bit integers, in this machine's order."""
    return array("I", ids).tobytes()


class Codec:
    """Encodes and decodes on one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs = vocabulary, Pairs(vocabulary)
        self.entries = vocabulary.entries
        special = set(vocabulary.special.values())
        self.id = {t: i for i, t in enumerate(self.entries) if t and i not in special and self.pairs.sound[i]}
        self.longest = ahocorasick.Automaton()
        for token, i in self.id.items():
            self.longest.add_word(token.decode("latin-1"), i)
        self.longest.make_automaton()
        self.length = np.array([len(t) for t in self.entries], np.int64)
        self.byte = [self.id[bytes([b])] for b in range(256)]
        made = np.flatnonzero(vocabulary.born >= 0)
        made = made[np.argsort(vocabulary.born[made])]
        self.made = made.tolist()  # by rank
        self.made_at, self.byte_at = made, np.array(self.byte, np.int64)
        self.rank = {k: r for r, k in enumerate((self.pairs.left[made] * self.pairs.n + self.pairs.right[made]).tolist())}
        self.cut, self.careful, self.later = regex.compile(PATTERN), regex.compile(CAREFUL), regex.compile(f"[{_LATER}]")
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known: dict[str, bytes] = {}
        self.merged_words = self.words = 0

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy: from the left of each word, always the longest token. Ids of all words, and the word of each."""
        text = BETWEEN.join(w.decode("latin-1") for w in words)
        found = np.fromiter(chain.from_iterable(self.longest.iter_long(text)), np.int64).reshape(-1, 2)
        ids = found[:, 1]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        of = np.searchsorted(ends, found[:, 0], side="right")
        if not np.array_equal(np.bincount(of, self.length[ids], len(words)), [len(w) for w in words]):
            raise AssertionError("the tokens proposed do not cover the words")
        return ids, of

    def merged(self, word: bytes) -> list[int]:
        """Exact: the adjacent pair of the lowest rank first, the leftmost of equal ones."""
        part, n, get = [self.byte[b] for b in word], self.pairs.n, self.rank.get
        if len(word) > SCANNED:
            return self._merged_long(part)
        ranks = [get(a * n + b, LAST) for a, b in zip(part, part[1:], strict=False)]
        while ranks and (r := min(ranks)) < LAST:
            i = ranks.index(r)
            own = part[i] = self.made[r]
            del part[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] * n + own, LAST)
            if i < len(ranks):
                ranks[i] = get(own * n + part[i + 1], LAST)
        return part

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """The packed ids that ``merged`` gives of every word, none empty; those that would be scanned take a merge each at a time, together."""
        out = [packed_ids(self.merged(w)) if len(w) > SCANNED else b"" for w in words]
        short = [k for k, w in enumerate(words) if len(w) <= SCANNED]
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            for k, ids in zip(some, self._merged_together([words[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _merged_together(self, words: list[bytes]) -> list[bytes]:
        """``merged_all`` of words that lie one after another in one array, where each round merges one pair of every word that has one left."""
        out: list[bytes] = [b""] * len(words)
        size, number = np.array([len(w) for w in words], np.int64), np.arange(len(words))
        part = self.byte_at[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.append(self.pairs.rank(part[:-1], part[1:]), NEVER)
        rank[np.cumsum(size) - 1] = NEVER
        while len(size):
            ends = np.cumsum(size)
            starts = ends - size
            low = np.minimum.reduceat(rank, starts)
            if not (live := low < NEVER).all():
                flat, at = part.astype(np.uint32).tobytes(), np.flatnonzero(~live)
                for k, lo, hi in zip(number[at].tolist(), (4 * starts[at]).tolist(), (4 * ends[at]).tolist(), strict=True):
                    out[k] = flat[lo:hi]
                inside = np.repeat(live, size)
                part, rank, size, number, low = part[inside], rank[inside], size[live], number[live], low[live]
                starts = np.cumsum(size) - size
            # the leftmost pair of the lowest rank of each word
            hits, of = np.flatnonzero(rank == np.repeat(low, size)), np.arange(len(size))
            place = hits[np.searchsorted(hits, starts)]
            part[place] = self.made_at[low]
            stays = np.ones(len(part), bool)
            stays[place + 1] = False
            rank[place] = rank[place + 1]  # that of the last part of a word is NEVER
            part, rank, place, size, starts = part[stays], rank[stays], place - of, size - 1, starts - of
            left, right = place[place > starts], place[place + 1 < starts + size]
            rank[left - 1] = self.pairs.rank(part[left - 1], part[left])
            rank[right] = self.pairs.rank(part[right], part[right + 1])
        return out

    def _merged_long(self, part: list[int]) -> list[int]:
        """``merged`` with a heap of the pairs, for words too long to be scanned for every merge."""
        size, n, get = len(part), self.pairs.n, self.rank.get
        following, preceding = list(range(1, size + 1)), list(range(-1, size - 1))
        waiting = [(r, i) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := get(a * n + b)) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = following[i]
            if part[i] < 0 or j >= size or get(part[i] * n + part[j]) != r:
                continue  # one of the two has become part of something else
            part[i], part[j] = self.made[r], -1
            k = following[i] = following[j]
            if k < size:
                preceding[k] = i
                if (r := get(part[i] * n + part[k])) is not None:
                    heapq.heappush(waiting, (r, i))
            if (h := preceding[i]) >= 0 and (r := get(part[h] * n + part[i])) is not None:
                heapq.heappush(waiting, (r, h))
        return [t for t in part if t >= 0]

    def learned(self, words: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of every distinct word: proposed for all, all pairs tested at once, the failing ones merged."""
        words = set(words)
        out = {w: self.known[w] for w in words if w in self.known}
        fresh = dict(zip(new := list(words.difference(out)), self._new(new), strict=True))
        if len(self.known) + len(fresh) > KNOWN:
            self.known = {}
        self.known.update((w, ids) for w, ids in islice(fresh.items(), KNOWN) if len(w) <= KEPT)
        return out | fresh

    def _new(self, words: list[str]) -> list[bytes]:
        """``learned``, in order, for words that are not known yet."""
        keys = [w.encode() for w in words]
        out = [None if i is None else packed_ids((i,)) for i in map(self.id.get, keys)]
        longer = [k for k, ids in enumerate(out) if ids is None]
        self.words += len(words)
        if longer:
            ids, of = self.proposed([keys[k] for k in longer])
            inside = of[1:] == of[:-1]
            pairs, place = np.unique(ids[:-1][inside] * self.pairs.n + ids[1:][inside], return_inverse=True)
            good = self.pairs.compatible(pairs // self.pairs.n, pairs % self.pairs.n)
            failing = np.zeros(len(longer), bool)
            failing[of[1:][inside][~good[place]]] = True
            starts, flat = (4 * np.searchsorted(of, np.arange(len(longer) + 1))).tolist(), ids.astype(np.uint32).tobytes()
            for k, lo, hi in zip(longer, starts[:-1], starts[1:], strict=True):
                out[k] = flat[lo:hi]
            again = [longer[i] for i in np.flatnonzero(failing).tolist()]
            for k, own in zip(again, self.merged_all([keys[k] for k in again]), strict=True):
                out[k] = own
            self.merged_words += int(failing.sum())
        return out

    def _words(self, text: str) -> Iterator[str]:
        cut = self.careful if has_later(text) else self.cut
        return (m.group() for m in cut.finditer(text)) if len(text) > PIECES else iter(cut.findall(text))

    def pieces(self, text: str) -> Iterator[str | int]:
        """The words of a text in order; a special token as its id."""
        if self.special is None or not self.special.search(text):
            return self._words(text)
        parts = enumerate(self.special.splititer(text))
        return chain.from_iterable([self.vocabulary.special[part]] if i % 2 else self._words(part) for i, part in parts)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        counts, found, block, held = [], [], [], 0

        def flush() -> None:
            ids = self.learned(set().union(*(words for _, words in block)).difference(self.vocabulary.special.values()))
            ids |= {i: packed_ids((i,)) for i in self.vocabulary.special.values()}
            for k, words in block:
                found.append(np.frombuffer(b"".join(map(ids.__getitem__, words)), np.uint32))
                counts[k] += len(found[-1])
            block.clear()

        for k, text in enumerate(texts):
            counts.append(0)
            rest = self.pieces(text or "")
            while words := list(islice(rest, PIECES)):
                block.append((k, words))
                if (held := held + len(words)) >= PIECES:
                    flush()
                    held = 0
        flush()
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array(counts, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are not UTF-8 as the replacement character. An unknown id is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.entries)):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(map(self.entries.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


@contextmanager
def codec(key: int, shared: Broadcast) -> Iterator[Codec]:
    """This worker's codec, for one task; then it keeps the vocabulary's tables and nothing of the texts. Another vocabulary replaces it."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    try:
        yield _codecs[key]
    finally:
        _codecs[key].known = {}
        pa.default_memory_pool().release_unused()


class Tokenizer:
    """Column expressions for one tokenizer file. The vocabulary is broadcast: its size is that of the file.

    Each value is mapped alone and whole, whatever its length, so other columns, ties, repeated
    rows and empty tables play no part. A null text counts as empty; null ids give null.
    Special tokens in a text become their ids, and none are added.
    """

    def __init__(self, spark: SparkSession, path: str):
        vocabulary = Vocabulary.read(path)
        shared = spark.sparkContext.broadcast(vocabulary)
        key = xxhash.xxh3_64_intdigest(b"\0".join([*vocabulary.entries, vocabulary.parts.tobytes(), vocabulary.born.tobytes()]))

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with codec(key, shared) as own:
                for texts in batches:
                    ids, counts = own.encode(texts.to_pylist())
                    yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.view(np.int32)))

        @F.arrow_udf("binary")
        def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with codec(key, shared) as own:
                for texts in batches:
                    ids, counts = own.encode(texts.to_pylist())
                    ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                    data = ids if sys.byteorder == "little" else ids.byteswap()
                    yield pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with codec(key, shared) as own:
                for lists in batches:
                    yield pa.array([own.decode(x.values.to_numpy()) if x.is_valid else None for x in lists], pa.string())

        @F.arrow_udf("string")
        def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with codec(key, shared) as own:
                for data in batches:
                    yield pa.array([own.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else None for x in data], pa.string())

        self._encode, self._pack, self._decode, self._unpack = encode, pack, decode, unpack

    def encode(self, text: str | Column) -> Column:
        """Ids of a text, as ``array<int>``."""
        return self._encode(text)

    def decode(self, ids: str | Column) -> Column:
        """Text of ``array<int>`` ids."""
        return self._decode(ids)

    def pack(self, text: str | Column) -> Column:
        """Ids of a text as token files hold them: unsigned 32-bit integers, the low byte first."""
        return self._pack(text)

    def unpack(self, data: str | Column) -> Column:
        """Text of packed ids."""
        return self._unpack(data)


def packed(df: DataFrame, path: str, text: str = "text", data: str = "data", back: str = "back") -> DataFrame:
    """``df`` with the packed ids of ``text`` and the text decoded from them; columns of those names are replaced."""
    tokenizer = Tokenizer(df.sparkSession, path)
    return df.withColumn(data, tokenizer.pack(F.col(f"`{text}`"))).withColumn(back, tokenizer.unpack(F.col(f"`{data}`")))
