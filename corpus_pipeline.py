"""The corpus pipeline: language filter, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Null texts, null ids, repeated rows and empty tables pass as
the operators define; a null or empty text is rejected by the first stage, since
it has no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import decontaminate, jaccard, language, line_dedup, pieces
from docweft.llm._common import save, spare
from docweft.llm.queries import MODEL_PATH

#: Share of n-grams that must fit a language (prose of a learned language is far above), and from how many n-grams on that counts against a text.
LEAST_SCORE, LEAST_GRAMS = 0.2, 20


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; learned from labelled rows, with the labels' own split.

    Texts that are null or have no letter go, and those of some length that fit no
    language; a text of a word or two stays. Repeated rows share their fate.
    """
    trained = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    lang, score, grams = spare(docs, "lang_pred"), spare(docs, "score"), spare(docs, "n_grams")
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # no column can clash with the detector's
    found = language.detect(docs.toDF(*names), language.fit(trained), names).toDF(*docs.columns, lang, score, grams)
    return found.filter((F.col(lang) != language.UNDETERMINED) & ((F.col(score) >= LEAST_SCORE) | (F.col(grams) < LEAST_GRAMS))).select(*_columns(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those left blank or null go, n_chars follows the text.

    Rows that repeat a document (id and text) are one document: all keep the same lines.
    """
    kept = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.filter(F.trim("text") != "")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the smallest doc_id, one row of it if rows repeat.

    Rows that share an id but not the text are documents of their own. Null, empty
    and wordless texts are classes of their own.
    """
    tk, own = spare(docs, "tk"), spare(docs, "own_id")
    found = jaccard.join_classes(docs).filter("first_of_class").select(F.col("doc_id").alias(own), F.col("tk").alias(tk)).distinct()
    keyed = docs.withColumn(tk, F.xxhash64("text")).alias("d")
    kept = keyed.join(found.alias("k"), (F.col(f"d.{tk}") == F.col(f"k.{tk}")) & F.col("d.doc_id").eqNullSafe(F.col(f"k.{own}")), "left_semi")
    return kept.dropDuplicates(["doc_id", tk]).select(*_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; repeated rows share their fate, null texts stay."""
    tk, own = spare(docs, "tk"), spare(docs, "own_id")
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("tk")).alias("doc_id"), "text")
    found = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = save(found.filter("contaminated").select(F.col("doc_id.doc_id").alias(own), F.col("doc_id.tk").alias(tk)).distinct(), "contaminated")
    keyed = docs.withColumn(tk, F.xxhash64("text")).alias("d")
    return keyed.join(bad.alias("b"), (F.col(f"d.{tk}") == F.col(f"b.{tk}")) & F.col("d.doc_id").eqNullSafe(F.col(f"b.{own}")), "left_anti").select(*_columns(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_fallback and exact of each document."""
    return pieces.encode(docs, pieces.PieceModel.load(spark, MODEL_PATH))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Language models and piece lattices have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
