"""Hard negatives by one-bit codes whose error is bounded for certain.

Vectors are scaled and rounded down to integers; a score is an inner product of those. For the
search a vector, less the mean, is rotated by a random orthogonal matrix, and the signs of what
comes out are its code: a unit vector c, with which the vector's alignment and the length of what c
leaves of it are stored. An anchor's product with c comes from counts of common bits with a few bit planes of the
rotated anchor. The rest of the vector is at right angles to c, so by Cauchy and Schwarz its
product with the anchor is at most its length times the length of what c leaves of the anchor:
every score lies in an interval known from the code. Candidates whose interval ends below what an
anchor has already found, or misses the band it looks in, are passed over; the others are scored
in integers, so the result is exact.

The anchors go through in chunks of bounded size, each broadcast to tasks that read all rows once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialized, shared_dir

#: Components are multiplied by this before they are rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from so many to so many hundredths of the positive's.
LOW, HIGH = 50, 95
#: Bit planes of an anchor.
PLANES = 4
#: About so many anchors are broadcast at once: a fixed number of vectors, whatever the table's size.
ANCHORS = 8192
#: Rows, and anchors, compared at once in a task; and pairs scored at once.
BLOCK, PAIRS = 512, 1 << 14
NONE = np.iinfo(np.int64).min


@dataclass
class Coder:
    """The rotation and the mean that codes are made with; a square of the number of components in size."""

    rotation: np.ndarray
    mean: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, seed: int) -> Coder:
        d = len(mean)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        return cls(q * np.sign(np.diag(r)), mean)

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sign bits in 64-bit words, alignment with the code's unit vector, and length of the rest."""
        y = (vectors - self.mean) @ self.rotation
        signs = y > 0
        align = np.abs(y).sum(axis=1) / np.sqrt(max(y.shape[1], 1))
        return words(signs), align, np.sqrt(np.maximum((y * y).sum(axis=1) - align * align, 0.0))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words; the last is filled up with zeros."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    short = -packed.shape[1] % 8 or (8 if packed.shape[1] == 0 else 0)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, short)))).view(np.uint64)


class Queries:
    """Anchors ready to be compared with codes: rotated, and cut into bit planes."""

    def __init__(self, coder: Coder, vectors: np.ndarray, planes: int = PLANES):
        q = vectors @ coder.rotation
        self.d = max(q.shape[1], 1)
        low, high = (q.min(axis=1), q.max(axis=1)) if q.shape[1] else (np.zeros(len(q)), np.zeros(len(q)))
        self.low, self.step = low, (high - low) / ((1 << planes) - 1)
        level = np.rint((q - low[:, None]) / np.where(self.step > 0, self.step, 1.0)[:, None]).astype(np.int64)
        self.planes = [words((level >> k) & 1 == 1) for k in range(planes)]
        cut = low[:, None] + self.step[:, None] * level  # as the planes have it
        self.total = cut.sum(axis=1)
        error = q - cut
        self.error = np.abs(error).sum(axis=1) / np.sqrt(self.d)  # of the product with any code
        self.square = (q * q).sum(axis=1)
        self.shift = vectors @ coder.mean
        self.slack = 1e-9 * (np.sqrt(self.square) * (1.0 + np.linalg.norm(coder.mean)))  # for rounding, times a vector's length

    def intervals(self, code: np.ndarray, align: np.ndarray, rest: np.ndarray, a: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each row with each anchor of ``a``."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        both = np.zeros((len(code), len(self.low[a])))
        for k, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                both += np.bitwise_count(code[:, None, w] & plane[a][None, :, w]) * float(1 << k)
        at = (2.0 * (ones[:, None] * self.low[a] + both * self.step[a]) - self.total[a]) / np.sqrt(self.d)
        least = np.maximum(np.abs(at) - self.error[a], 0.0)
        half = rest[:, None] * np.sqrt(np.maximum(self.square[a] - least * least, 0.0)) + align[:, None] * self.error[a]
        half += self.slack[a] * (1.0 + align + rest)[:, None] + 1e-6
        at *= align[:, None]
        at += self.shift[a]
        return at - half, at + half


class Best:
    """The ``k`` best of each group so far: highest score, then smallest identifier (null last), then first row."""

    def __init__(self, groups: int, k: int):
        self.k, self.held = k, [np.empty(0, np.int64) for _ in range(4)]
        self.least = np.full(groups, NONE)  # the k-th score, once there are k

    def add(self, group: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i, r = (np.concatenate(x) for x in zip(self.held, (group, score, id, row), strict=True))
        order = np.lexsort((r, i, r < 0, -s, g))
        g, s, i, r = g[order], s[order], i[order], r[order]
        keep = np.arange(len(g)) - np.searchsorted(g, g) < self.k
        self.held = [x[keep] for x in (g, s, i, r)]
        g, s = self.held[:2]
        full = np.flatnonzero(np.arange(len(g)) - np.searchsorted(g, g) == self.k - 1)
        self.least[g[full]] = s[full]


@dataclass
class Chunk:
    """Some anchors, as every task gets them."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    queries: Queries
    bands: np.ndarray | None = None  # (anchor, low, high, positive score) of each band that has room


class Rows:
    """Some coded rows as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        self.row, self.label = t["row"].to_numpy(), t["label"].to_numpy()
        self.id = t["id"].fill_null(0).to_numpy()
        self.align, self.rest = t["align"].to_numpy(), t["rest"].to_numpy()
        self.vectors = _matrix(t["v"])
        self.code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(len(t), -1)

    @staticmethod
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            if (n := n + b.num_rows) >= BLOCK:
                yield Rows(held)
                held, n = [], 0
        if n:
            yield Rows(held)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0), np.int64)


def scores(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows ``i`` of one matrix with rows ``j`` of another, so many at once."""
    parts = [slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)]
    return np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", x[i[p]], y[j[p]]) for p in parts)])


def nearest(chunk: Chunk, blocks: Iterator[Rows], k: int) -> tuple[Best, int]:
    """The ``k`` best other rows of every anchor's label, and how many were scored."""
    best, scored = Best(len(chunk.row), k), 0
    by_label = {int(v): np.flatnonzero(chunk.label == v) for v in np.unique(chunk.label)}
    for rows in blocks:
        for value in np.unique(rows.label).tolist():
            mine = np.flatnonzero(rows.label == value)
            for anchors in np.array_split(by_label.get(value, np.empty(0, np.int64)), max(1, -(-len(by_label.get(value, ())) // BLOCK))):
                if not len(anchors):
                    continue
                _, high = chunk.queries.intervals(rows.code[mine], rows.align[mine], rows.rest[mine], anchors)
                i, a = np.nonzero((high >= best.least[anchors]) & (rows.row[mine][:, None] != chunk.row[anchors]))
                i, a = mine[i], anchors[a]
                scored += len(i)
                best.add(a, scores(rows.vectors, i, chunk.vectors, a), rows.id[i], rows.row[i])
    return best, scored


def inside(chunk: Chunk, blocks: Iterator[Rows], k: int) -> tuple[Best, int]:
    """The ``k`` best rows of other labels in every band, and how many were scored."""
    anchor, low, high, _ = chunk.bands
    best, scored = Best(len(anchor), k), 0
    first = np.searchsorted(anchor, np.arange(len(chunk.row) + 1))  # bands are in order of their anchors
    busy = np.flatnonzero(np.diff(first))
    for rows in blocks:
        for at in range(0, len(busy), BLOCK):
            a = busy[at : at + BLOCK]
            least, most = chunk.queries.intervals(rows.code, rows.align, rows.rest, a)
            needed = np.maximum(low, best.least)
            floor = np.minimum.reduceat(needed, first[a])[: len(a)] if len(a) else needed
            roof = np.maximum.reduceat(high, first[a])[: len(a)]
            i, j = np.nonzero((most >= floor) & (least <= roof) & (rows.label[:, None] != chunk.label[a]))
            j = a[j]
            s = scores(rows.vectors, i, chunk.vectors, j)
            scored += len(i)
            for slot in range(int(np.diff(first).max(initial=0))):
                band = first[j] + slot
                ok = band < first[j + 1]
                band, score, row = band[ok], s[ok], i[ok]
                fits = (score >= np.maximum(low[band], best.least[band])) & (score <= high[band])
                band, score, row = band[fits], score[fits], row[fits]
                best.add(band, score, rows.id[row], rows.row[row])
    return best, scored


def coded(df: DataFrame, id: str, vector: str, label: str, anchor: Column, scale: int, seed: int) -> tuple[DataFrame, Coder]:
    """(row, id, label, is_anchor, v, code, align, rest) of the rows that take part, written; and what made the codes."""
    x = F.col(f"`{vector}`")
    usable = F.col(f"`{label}`").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    taken = df.where(F.coalesce(usable, F.lit(False))).select(
        F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), whole.alias("v")
    )
    row = F.monotonically_increasing_id()
    taken = materialized(taken.withColumn("row", F.when(F.col("id").isNull(), -row - 1).otherwise(row)))  # below zero without an identifier
    d = taken.agg(F.max(F.size("v"))).first()[0] or 0
    same = taken.withColumn("v", F.transform(F.array_repeat(F.lit(0), d), lambda _, i: F.coalesce(F.get("v", i), F.lit(0).cast("bigint")))) if d else taken
    mean = same.select(Summarizer.mean(array_to_vector(F.col("v").cast("array<double>"))).alias("m")).first()["m"].toArray() if d else np.zeros(0)
    coder = Coder.of(mean, seed)
    shared = df.sparkSession.sparkContext.broadcast(coder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, align, rest = shared.value.codes(_matrix(pa.chunked_array([b["v"]])))
            columns = [*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "code", "align", "rest"])

    kind = "id bigint, label bigint, is_anchor boolean, v array<bigint>, row bigint, code binary, align double, rest double"
    return materialized(same.mapInArrow(encode, kind)), coder


def mined(
    df: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, planes: int = PLANES, anchors: int = ANCHORS, seed: int = 0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    An anchor's positives are the ``positives`` best other rows of its label; for each, the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the
    positive's are given, none if there are none. Higher scores come first, then smaller
    identifiers, null last, then the order of rows, so equal rows are all there. Rows with a null
    label or vector or a component that is null or not finite take no part; a row without an
    identifier is no anchor unless ``anchor`` says so. Shorter vectors end in zeros. Scores must fit 64 bits. Other columns are
    not read, whatever their names. An empty table, or one without anchors, gives no rows.
    """
    spark = df.sparkSession
    rows, coder = coded(df, id, vector, label, anchor, scale, seed)
    out = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], kind).write.parquet(out)
    chosen = rows.where("is_anchor")
    total = chosen.count()
    parts = -(-total // anchors)
    for part in range(parts):
        own = chosen.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).select("row", "id", "label", "v").toArrow()
        if own.num_rows:
            _mined(rows, coder, own, positives, negatives, low, high, planes).write.mode("append").parquet(out)
    return spark.read.schema(kind).parquet(out)


def _mined(rows: DataFrame, coder: Coder, own: pa.Table, positives: int, negatives: int, low: int, high: int, planes: int) -> DataFrame:
    """``mined`` for one chunk of anchors."""
    spark = rows.sparkSession
    vectors = _matrix(own["v"])
    chunk = Chunk(own["row"].to_numpy(), own["label"].to_numpy(), vectors, Queries(coder, vectors, planes))
    found = _searched(rows, chunk, nearest, positives)
    # at most ``positives`` rows for every anchor of the chunk
    kept = found.select("group", "score", "place", "id").toArrow().sort_by([("group", "ascending"), ("place", "ascending")])
    group, score = kept["group"].to_numpy(), kept["score"].to_numpy()
    bands = np.unique(np.stack([group, -(-low * score // 100), high * score // 100, score]), axis=1) if len(group) else np.empty((4, 0), np.int64)
    chunk.bands = bands[:, bands[1] <= bands[2]]
    hard = _searched(rows, chunk, inside, negatives)
    ids = own["id"].to_pylist()
    told = [(int(g), ids[g], i, int(s)) for g, i, s in zip(group, kept["id"].to_pylist(), score, strict=True)]
    pairs = spark.createDataFrame(told, "anchor int, anchor_id bigint, positive_id bigint, positive_score bigint")
    band = spark.createDataFrame([(k, int(a), int(s)) for k, (a, _, _, s) in enumerate(chunk.bands.T)], "group bigint, anchor int, positive_score bigint")
    hard = hard.select("group", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(band, ["anchor", "positive_score"]).join(hard, "group")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _searched(rows: DataFrame, chunk: Chunk, search, k: int) -> DataFrame:
    """(group, score, id, row, place) of the ``k`` best of each group: the best of every task, ranked together."""
    shared = rows.sparkSession.sparkContext.broadcast(chunk)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, _ = search(shared.value, Rows.blocks(batches), k)
        group, score, id, row = best.held
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(score), pa.array(id, mask=row < 0), pa.array(row)], ["group", "score", "id", "row"])

    found = rows.select("row", "id", "label", "v", "code", "align", "rest").mapInArrow(look, "group bigint, score bigint, id bigint, row bigint")
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return materialized(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
