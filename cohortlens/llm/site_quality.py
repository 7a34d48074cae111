"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model on a text's surface and hashed words gives each document its own evidence.
Hosts, and paths within hosts, have a posterior mean quality that is shrunk towards the
level above: by how much is estimated from the variance between and within groups, so that
sparse sites stay near the global prior. A document's score adds to its own log-odds what
the rest of its site says; its own evidence is taken out of the site's sums first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.rows import about, small_batches, small_enough
from cohortlens.session import materialized

#: About so many labelled documents to fit on, chosen by hash; hashed word columns; strength of the ridge.
SAMPLE, HASHED, RIDGE = 3_000, 512, 1.0
#: Score from which a document is kept.
KEEP = 0.5
#: A group level whose variance cannot be told from chance is shrunk as by so many documents.
MOST = 1e6
_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&|<>", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"\n", b" \t\r\v\f"), 1):
    _KIND[list(_chars)] = _k
SURFACE = 12


def features(data: bytes) -> np.ndarray:
    """Surface shares of a text's bytes, then the square roots of the shares of hashed words."""
    out = np.zeros(SURFACE + HASHED)
    words, n = data.split(), max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8)[:8] if data else np.zeros(8)
    out[:7] = np.sqrt(kinds[1:8] / n)
    if words:
        out[7] = len(set(words)) / len(words)
        out[8] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[9] = min(3.0, len(data) / len(words) / 8)
        out[10] = min(1.0, len(words) / 50)
        lines = data.split(b"\n")
        out[11] = len(set(lines)) / len(lines)
        at = np.fromiter(map(crc32, words), np.uint32, len(words)) % HASHED
        out[SURFACE:] = np.sqrt(np.bincount(at, minlength=HASHED) / len(words))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # bias last

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -12, 12)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Model:
    """Ridge logistic regression by Newton steps. Of one class only, or none, the evidence is always 0."""
    model = Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1))
    if len(set(y.tolist())) < 2:
        return model
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    penalty = ridge * np.append(np.full(x.shape[1], 1.0), 1e-6)
    w = model.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int = SAMPLE) -> Model:
    """Fit on all or about ``rows`` labelled documents, whole; of several labels of one identifier the worst holds."""

    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    known = labels.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("_id")).agg(F.min(f"`{label}`").alias("_y"))
    known = materialized(known)
    known = about(known, "_id", rows, known.count())
    texts = docs.select(F.col(f"`{id}`").alias("_id"), _bytes(text).alias("_t")).join(F.broadcast(known), "_id")
    once = texts.groupBy("_id", "_y").agg(F.min("_t").alias("_t"))  # a row per labelled identifier
    drawn = sorted(once.select("_id", "_y", measure("_t").alias("x")).collect())
    if not drawn:
        return fitted(np.zeros((0, SURFACE + HASHED)), np.zeros(0))
    return fitted(np.array([r.x for r in drawn]), np.array([float(r._y) for r in drawn]))


def log_odds(model: Model, df: DataFrame, text: str) -> Column:
    """A document's own evidence. The model is broadcast; its size is fixed."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = texts.to_pylist()
            yield pa.array(shared.value.log_odds(np.array([features(t) for t in rows])) if rows else [], pa.float64())

    return score(_bytes(text))


def shrinkage(groups: DataFrame, mean: Column) -> float:
    """How many documents the level above is worth: variance within groups over variance between them.

    ``groups`` has a row per group with its count n, sum s and sum of squares q; ``mean`` is that of the level above.
    """
    n = F.col("n")
    own = F.col("s") / n
    r = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n.cast("double") * n).alias("nn"),
        F.sum(n * F.pow(own - mean, F.lit(2))).alias("between"), F.sum(F.col("q") - n * own * own).alias("within"),
    ).first()
    if not r.n or r.k < 2 or r.n <= r.k:
        return MOST
    within = max(r.within, 1e-9) / (r.n - r.k)
    between = (r.between - (r.k - 1) * within) / max(1e-9, r.n - r.nn / r.n)
    return min(MOST, within / between) if between > 0 else MOST


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def scored(evidence: DataFrame, id: str = "id", host: str = "host", path: str = "path", odds: str = "odds", keep: float = KEEP) -> DataFrame:
    """(id, own_score, host_quality, path_quality, score, kept) from (id, host, path, odds), which was written.

    Only sums per path are shuffled; null hosts and paths are groups of their own. A document
    alone on its path or host has the level above as its prior. Empty tables give no rows.
    """
    p = 1 / (1 + F.exp(-F.col(odds)))
    e = evidence.select(F.col(id).alias("_id"), F.col(host).alias("_h"), F.col(path).alias("_p"), F.col(odds).alias("_o"), p.alias("_y"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")]
    paths = materialized(e.groupBy("_h", "_p").agg(*sums))
    hosts = materialized(paths.groupBy("_h").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = F.lit(all_.s / all_.n if all_.n else 0.5)
    above = hosts.select(F.col("_h").alias("_hh"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    placed = materialized(paths.join(small_enough(above), F.col("_h").eqNullSafe(F.col("_hh"))).drop("_hh"))
    of_host, of_path = F.lit(shrinkage(hosts, mean)), F.lit(shrinkage(placed, F.col("hs") / F.col("hn")))
    placed = placed.withColumnsRenamed({"_h": "_ph", "_p": "_pp"})
    d = e.join(small_enough(placed), F.col("_h").eqNullSafe(F.col("_ph")) & F.col("_p").eqNullSafe(F.col("_pp")))
    d = d.withColumn("_host", (F.col("hs") - F.col("_y") + of_host * mean) / (F.col("hn") - 1 + of_host))
    d = d.withColumn("_path", (F.col("s") - F.col("_y") + of_path * F.col("_host")) / (F.col("n") - 1 + of_path))
    score = 1 / (1 + F.exp(-(F.col("_o") + _logit(F.col("_path")) - _logit(mean))))
    return d.select(
        F.col("_id").alias(id), F.col("_y").alias("own_score"), F.col("_host").alias("host_quality"), F.col("_path").alias("path_quality"),
        score.alias("score"), (score >= keep).alias("kept"),
    )


def classified(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id: str = "doc_id", text: str = "text", label: str = "quality", keep: float = KEEP,
) -> DataFrame:
    """``scored`` for every row of ``docs``; null text is empty text. Each text is measured once, whole.

    A score equal to ``keep`` is kept. Repeated rows count each in their site and get equal scores;
    other columns are not read, unless ``host`` or ``path`` do; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id, text, label)
    evidence = materialized(docs.select(F.col(f"`{id}`").alias("id"), host.alias("host"), path.alias("path"), log_odds(model, docs, text).alias("odds")))
    return scored(evidence, keep=keep).withColumnRenamed("id", id)
