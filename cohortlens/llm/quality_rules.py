"""Quality rules: base counts, and a hashed n-gram likelihood ratio of target against raw text.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the
buckets, of a trusted target and of the whole corpus, give each n-gram a log-likelihood
ratio; a document's mean ratio per n-gram is compared with a fixed threshold, so the verdict
on a document depends on nothing but its text and the counts. Everything is built-in
expressions; texts never leave the row they are in, and only bucket counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.rows import let, words_of

#: Buckets of the multinomials; their tables are the only thing sent to the executors.
BUCKETS = 1 << 14
#: Added to each bucket's share of the larger counts, so that rare n-grams say little.
PRIOR = 1.0
#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.06
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column) -> Column:
    """Number of words in three-word windows that occur at least twice, from the hashes of the words.

    If the windows' 64-bit hashes are all distinct there is none. Else equal ones are made
    neighbours by a sort; of the places found, each adds the words that the one before did not cover.
    """
    windows = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    none = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    return let(hashes, lambda h: let(windows(h), lambda w: F.when(none(w), F.lit(0).cast("long")).otherwise(_covered(w))))


def _covered(windows: Column) -> Column:
    """Words in the windows whose hash occurs again.

    A window's hash and place share one 64-bit number, which costs the hash its upper bits but
    sorts as plain numbers. Only where that makes unequal hashes equal, structs of the whole hash
    and the place are sorted instead, so no bits are lost with length.
    """
    places = F.length(F.bin(F.size(windows)))  # bits that hold a place
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), places) - 1
    short = lambda x: F.call_function("shiftleft", x, places)
    high = lambda x: F.call_function("shiftrightunsigned", x, places)
    packed = lambda w: F.transform(w, lambda x, i: short(x).bitwiseOR(i.cast("long")))
    paired = lambda w: F.transform(w, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p")))
    as_many = lambda w: F.size(F.array_distinct(F.transform(w, short))) == F.size(F.array_distinct(w))
    fast = lambda w: _words(packed(w), high, lambda x: x.bitwiseAND(mask))
    whole = lambda w: _words(paired(w), lambda x: x["h"], lambda x: x["p"])
    return let(windows, lambda w: F.when(as_many(w), fast(w)).otherwise(whole(w)))


def _words(keys: Column, value: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """Words in the windows whose value occurs again, from keys that sort by value and place."""
    again = lambda s: F.transform(s, lambda x, i: F.when((value(x) == value(F.get(s, i - 1))) | (value(x) == value(F.get(s, i + 1))), place(x)))
    three = F.lit(3).cast("long")
    new = lambda a: F.transform(a, lambda p, i: F.coalesce(F.least(three, p - F.get(a, i - 1)), three))
    return let(F.sort_array(keys), lambda s: let(F.array_sort(F.array_compact(again(s))), lambda a: _total(new(a), "long")))


def _total(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, " \t\x0b\f\r", "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours, from an array of word hashes."""
    one = F.transform(hashes, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(hashes, F.lit(2), F.size(hashes)), lambda x, i: F.pmod(F.xxhash64(F.get(hashes, i), x), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def bucket_counts(df: DataFrame, text: str, target: Column, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows and of those for which ``target`` holds. Summed within tasks first."""
    d = df.select(F.coalesce(target, F.lit(False)).cast("long").alias("_t"), let(word_hashes(F.col(f"`{text}`")), lambda h: grams(h, buckets)).alias("_g"))
    return d.select("_t", F.explode("_g").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, prior: float = PRIOR) -> list[float]:
    """The log-likelihood ratio of every bucket, smoothed; ``buckets`` numbers, whatever the corpus."""
    every = Window.partitionBy(F.lit(0))
    all_ = F.sum("raw").over(every), F.sum("target").over(every)
    p = (F.col("target") + prior * F.col("raw") / all_[0] * buckets) / (all_[1] + prior * buckets)
    ratio = F.log(p / (F.col("raw") / all_[0]))
    found = {r.bucket: r.v for r in counts.select("bucket", ratio.alias("v")).collect()}
    return [found.get(b, 0.0) for b in range(buckets)]


def judged(
    df: DataFrame, target: Column, id: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, threshold: float = THRESHOLD, prior: float = PRIOR,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) per row.

    ``target`` says which rows are trusted; with none, or an empty table, every ratio is 0 and
    only the base rules reject. Null text has no words; a text without words has ratio 0. Each
    row is judged alone, so repeated rows get equal verdicts. Texts are counted whole, of any length
    that a row can hold; other columns are not read, unless ``target`` does.
    """
    table = log_ratios(bucket_counts(df, text, target, buckets), buckets, prior)
    values = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # a constant of the plan
    t, lines = F.coalesce(F.col(f"`{text}`"), F.lit("")), repeated_lines(F.coalesce(F.col(f"`{text}`"), F.lit("")))

    def of(h: Column) -> Column:
        n = F.size(h)
        score = F.aggregate(F.transform(grams(h, buckets), lambda b: F.get(values, b)), F.lit(0.0), lambda a, x: a + x)
        return F.struct(n.cast("long").alias("n"), repeated_words(h).alias("again"), (score / F.greatest(F.lit(1), 2 * n - 1)).alias("ratio"))

    bare = F.translate(t, " \t\n\x0b\f\r", "")
    d = df.select(
        F.col(f"`{id}`"), let(word_hashes(t), of).alias("_w"), F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("n_dup_lines"),
    )
    failed = (F.col("_w.n") < MIN_WORDS) | (F.col("_w.again") > MAX_REPEATED * F.col("_w.n"))
    return d.select(
        F.col(f"`{id}`"), F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.again").alias("n_repeat_words"),
        failed.alias("base_failed"), F.col("_w.ratio").alias("ratio"), (~failed & (F.col("_w.ratio") >= threshold)).alias("kept"),
    )
