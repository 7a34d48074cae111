"""Language ID by string kernels with Nystroem landmarks and kernel ridge regression.

A text is the set of its byte n-grams of orders 1 to 3 (a blended spectrum, presence only);
the kernel of two texts is the size of the intersection over the geometric mean of the two
sizes. A few labelled texts are landmarks: a text is described by its kernel with each,
and one-versus-rest ridge regression on the Nystroem features gives a score per language.
Fitting is on a sample of so many texts a language; texts are scored in batches by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.rows import small_enough
from cohortlens.session import materialized

#: The sample to fit on: per language so many texts, of any length; and how many of them are landmarks.
SAMPLE, LANDMARKS = 240, 40
RIDGE = 1e-2
#: How sharply the regression's values become a probability.
SHARPNESS = 6.0
UNKNOWN = "und"
#: Where the codes of each order begin, and how many codes there are.
STARTS, CODES = (0, 1 << 8, (1 << 8) + (1 << 16)), (1 << 8) + (1 << 16) + (1 << 24)
#: Bytes of a text of which n-grams are taken at once.
BLOCK = 1 << 18
#: Texts in one matrix product.
ROWS = 128
#: ASCII bytes that are not letters become spaces.
_FOLD = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def lettered(text: Column) -> Column:
    """``has_letter`` as an expression."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Grams:
    """The distinct n-grams of a text, with one reusable table for which were seen."""

    def __init__(self):
        self.seen = np.zeros(CODES, np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        """Codes of the distinct n-grams. Texts are lower-cased and framed by spaces; runs of blanks are one."""
        data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" ", np.uint8)
        found = []
        for lo in range(0, len(data), BLOCK):
            part = data[lo : lo + BLOCK + 2].astype(np.int32)
            pairs = (part[:-1] << 8) | part[1:]
            for codes in (part, pairs + STARTS[1], ((pairs[:-1] << 8) | part[2:]) + STARTS[2]):
                new = codes[self.seen[codes] == 0]
                self.seen[new] = 1
                found.append(np.unique(new))
        codes = np.concatenate(found)
        self.seen[codes] = 0
        return codes


@dataclass
class Model:
    """Landmark n-grams, landmark presence, and the weights from kernel values to languages."""

    langs: list[str]
    codes: np.ndarray  # sorted codes that any landmark has
    presence: np.ndarray  # landmark x code, 1 or 0
    sizes: np.ndarray  # number of n-grams of each landmark
    weights: np.ndarray  # (landmark + 1) x language

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """Text x landmark kernel values: intersections as one product of presence matrices."""
        own = np.zeros((len(sets), len(self.codes)), np.float32)
        for row, codes in zip(own, sets, strict=True):
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            row[at[self.codes[at] == codes]] = 1
        return (own @ self.presence.T) / np.sqrt(np.maximum([len(s) for s in sets], 1)[:, None] * self.sizes[None, :])

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """Text x language values of the regressions."""
        k = self.kernels(sets)
        return np.hstack([k, np.ones((len(k), 1), k.dtype)]) @ self.weights


def fitted(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on texts with their languages; the first ``landmarks`` of each language are landmarks."""
    grams = Grams()
    return fitted_sets([grams(t) for t in texts], labels, landmarks, ridge)


def fitted_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``fitted`` on the texts' n-grams."""
    langs = sorted(set(labels))
    chosen = [i for g in langs for i in [k for k, lab in enumerate(labels) if lab == g][:landmarks]]
    codes = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(1, np.int32)
    presence = np.zeros((len(chosen), len(codes)), np.float32)
    for row, i in zip(presence, chosen, strict=True):
        row[np.searchsorted(codes, sets[i])] = 1
    model = Model(langs, codes, presence, np.array([len(sets[i]) for i in chosen], np.float32), np.zeros((len(chosen) + 1, len(langs)), np.float32))
    if len(langs) < 2:
        return model
    k = np.vstack([model.kernels(sets[lo : lo + ROWS]) for lo in range(0, len(sets), ROWS)]).astype(np.float64)
    own, vectors = np.linalg.eigh(k[chosen])  # Nystroem: K_nm K_mm^(-1/2)
    root = vectors / np.sqrt(np.maximum(own, 1e-8)) @ vectors.T
    x = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    balance = np.array([1.0 / labels.count(lab) for lab in labels])[:, None] * len(labels) / len(langs)
    w = np.linalg.solve(x.T @ (balance * x) + ridge * np.eye(x.shape[1]), x.T @ (balance * y))
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def sample(df: DataFrame, id: str, text: str, lang: str, rows: int = SAMPLE) -> DataFrame:
    """(lang, h, t, text): the ``rows`` texts of each language with the smallest hash of the identifier, of any length.

    Chosen by hashes alone, ranked within tasks before the shuffle; only texts that were chosen
    are shuffled, and copies under one identifier count once.
    """
    d = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.lit("fit"), f"`{id}`").alias("h"))
    d = d.where(F.col("lang").isNotNull() & lettered(F.col("text"))).withColumn("t", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    chosen = materialized(d.select("lang", "h", "t").withColumn("place", place).where(F.col("place") <= rows).select("lang", "h", "t").distinct())
    return d.join(small_enough(chosen), ["lang", "h", "t"]).groupBy("lang", "h", "t").agg(F.min("text").alias("text"))


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE) -> Model:
    """A model of the languages in ``df``; null languages and texts are left out.

    The n-grams of whole texts are taken in the tasks; of a text only its distinct codes reach the driver.
    """

    @F.arrow_udf("binary")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for texts in batches:
            yield pa.array([grams(t).astype(np.int32).tobytes() for t in texts.to_pylist()], pa.binary())

    drawn = sorted(sample(df, id, text, lang, rows).select("lang", "h", "t", codes("text").alias("codes")).collect())
    return fitted_sets([np.frombuffer(r.codes, np.int32) for r in drawn], [r.lang for r in drawn])


def predicted(model: Model, texts: list[str | None], grams: Grams | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and scores; ``und`` with score 0 for a text that is null or has no letter, or if no language was learned."""
    grams = grams or Grams()
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
    for lo in range(0, len(known), ROWS):
        rows = known[lo : lo + ROWS]
        values = np.exp(SHARPNESS / 2 * model.values([grams(texts[i]) for i in rows]).astype(np.float64))
        best = values.argmax(axis=1)
        scores[rows] = values[np.arange(len(rows)), best] / values.sum(axis=1)
        for i, b in zip(rows, best.tolist(), strict=True):
            langs[i] = model.langs[b]
    return langs, scores


def language(model: Model, df: DataFrame, text: Column) -> Column:
    """struct(lang, score) of a text. The model is broadcast; its size follows from the sample's bounds."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()  # its table goes with the task
        for texts in batches:
            langs, scores = predicted(shared.value, texts.to_pylist(), grams)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(text)


def held_out(id: Column) -> Column:
    """The quarter of documents that a model must not learn from; a null identifier is not in it."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) per row, from a model of the rows that are not held out.

    Null languages teach nothing. Texts are scored whole, one by one; ties between languages go
    to the first in order; an empty table gives no rows. Repeated rows are scored alike, and copies
    under one identifier teach once; other columns are not read, whatever their names.
    """
    model = fit(df.where(~held_out(F.col(f"`{id}`"))), id, text, lang)
    out = df.select(F.col(f"`{id}`"), held_out(F.col(f"`{id}`")).alias("held_out"), language(model, df, F.col(f"`{text}`")).alias("_found"))
    return out.select(F.col(f"`{id}`"), "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))
