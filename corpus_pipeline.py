"""From raw documents to packed sequences: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.llm.line_dedup import dedup_lines
from sitelume.llm.mixing import Mix
from sitelume.llm.near_dup import one_of_each
from sitelume.llm.packing import pack_documents
from sitelume.llm.scratch import Scratch
from sitelume.llm.toxicity import learn_lexicon, reject_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars as the text's length, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from all labels rejects are left out.

    Null and empty texts stay, as do all texts where no label is known. Each
    row is judged by its whole text, however long: repeated rows and null ids
    go or stay alike. An empty table stays empty; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject_toxic(docs, learn_lexicon(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of 50 words or more are cut out; documents that were nothing else go.

    Null and empty texts stay. Of equal copies the one of the smallest id is
    the first, null ids come last; repeated rows are one document and stay
    alike. Very long texts are split whole. An empty table stays empty; other
    columns pass through, but for n_chars, if there is one, which follows the
    text, and for n_lines, n_removed and emptied, which the operator uses.
    """
    cleaned = dedup_lines(docs).where("NOT coalesce(emptied, false)")
    return _counted(cleaned.select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Null and empty texts all stay. Rows equal in id and text are one document,
    of which one row stays. Groups without any id keep one document. Sets are
    those of whole texts, however long. An empty table stays empty; other
    columns pass through.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target shares: a row for each document and pass, with the words it gives.

    Texts without words, null ones too, give nothing and leave. A null source
    is a source; null ids and repeated rows are documents like any other. Very
    long texts are drawn block by block. An empty table stays empty; other
    columns pass through, n_chars, if there is one, follows the text.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    return _counted(Mix(docs, carry=carry).texts(with_pass=False)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as token sequences of at most 2048, by piece.

    Null and empty texts are one end token. Each row is a document, repeated
    ones and those without an id too. Very long texts are encoded whole and
    cut. An empty table gives no pieces; other columns are left out.
    """
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minmax_near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("cost_balanced_packing", packing),
]

#: Learned scores, pseudorandom draws and tokenizers have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
