"""A text corpus from documents to tokens, in stages that are each written and read again.

Language ID, exact de-duplication, near de-duplication, mixing to target weights, encoding.
All but the last return the columns of ``documents``; each works on all that the one before kept.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bagminhash, bpe, exact, language, mixing
from cohortlens.llm.rows import RowMarks, free_name, small_batches
from cohortlens.session import materialized, shared_dir

#: Language ID rejects texts in no language, and those whose best language is less likely than this.
LEAST_SCORE = 0.35


#: The columns that stages use; any other may have any name, for it has another one inside a stage.
COLUMNS = ("doc_id", "text", "lang", "source")


def passing(stage):
    """``stage`` for tables with further columns of any names: they pass through it unseen, and come out as they were.

    A column called as a helper column of the stage, or as Spark's ``_metadata``, is thus neither lost nor mixed up.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"passing {i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@passing
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or below ``LEAST_SCORE`` go.

    If no language could be learned (no labelled text with a letter), only null texts and texts without letters go.
    Texts are judged whole and one by one, equal ones alike; an empty table gives no rows.
    """
    small_batches(spark)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(language.lettered(F.col("text")))
    name = free_name(docs, "found")
    found = docs.withColumn(name, language.language(model, docs, F.col("text")))
    return found.where((F.col(f"{name}.lang") != language.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


@passing
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id.

    Null is empty text; a null doc_id stays only where all are null, the first row by place of equal
    ones; texts of any length are compared whole; an empty table gives no rows.
    """
    placed = exact.located(docs)
    return exact.kept_rows(placed, exact.dedup(placed))


@passing
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id.

    Null and wordless texts are one class; null doc_ids and equal ones as in ``drop_copies``; whole
    texts of any length are compared; an empty table gives no rows.
    """
    placed = exact.located(docs)
    return exact.kept_rows(placed, bagminhash.near_duplicates(placed))


@passing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words, so taking them costs nothing and changes no target; a null
    source is a source; equal rows are ranked one after another; an empty table gives no rows.
    """
    placed = exact.located(docs)
    often, copy = free_name(docs, "often"), free_name(docs, "copy")
    taken = materialized(mixing.mixed(placed, keep=["_path", "_row"]).where("copies > 0").select("_path", "_row", F.col("copies").alias(often)))
    marks = RowMarks(taken, {"once": F.col(often) >= 1, "twice": F.col(often) >= 2})  # MOST allows no third copy
    if marks.bits is None:
        out = placed.join(taken, ["_path", "_row"])
    else:  # texts stay where they are
        marked, is_set = marks.on(placed)
        out = marked.where(is_set["once"]).withColumn(often, F.when(is_set["twice"], 2).otherwise(1))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), often))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens, decodes) per row; ``decodes`` tells whether the ids give the text back.

    A null text is encoded as an empty one; whole texts of any length, one by one; further columns
    are left out, whatever their names; an empty table gives no rows.
    """
    import public_tokenizers

    small_batches(spark)
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = docs.select("doc_id", "source", "lang", "text", tokenizer.both("text").alias("both"))
    whole = F.col("both.data") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "source", "lang", "both.ids", F.size("both.ids").cast("long").alias("n_tokens"), whole.alias("decodes"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix),
    ("byte_bpe", encode),
]
#: The stages use a fitted model, hashing of word sequences and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
