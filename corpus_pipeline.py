"""A training corpus from the table ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, multiorder, spviterbi, suffixes, support
from millrace.llm.queries import prepare, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, of no known language or of doubtful language go: null and empty texts too.

    Rows that repeat are judged alike and all stay or go; null ids and further columns are kept; an empty table
    stays empty. Evidence: text, ``lang`` and ``source`` (documents have no address)."""
    prepare(spark)
    return langid.identify(docs).filter("lang_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays.

    Texts without words are in no group and stay; rows that repeat id and text become one; a null id counts as
    the smallest; further columns are kept; an empty table stays empty."""
    prepare(spark)
    return multiorder.representatives(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document of which no word is left goes: null and empty texts too.

    Repeated rows lose what they share, all of them; null ids and further columns are kept, ``n_chars`` is the
    new length; an empty table stays empty."""
    prepare(spark)
    out = suffixes.clean(docs).filter(F.regexp_count("text", F.lit(mixing.WORD)) > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands once for each pass that takes words of it.

    Texts without words are never taken; a null source is a source of its own; rows that repeat id and text have
    each their place in the mix; further columns are kept; an empty table stays empty."""
    prepare(spark)
    return mixing.mixed_documents(docs, mixing.mix(docs, block=512))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids of every row; null and empty texts have no ids, repeated rows and null ids stay, other
    columns are not read, an empty table stays empty."""
    prepare(spark)
    out = spviterbi.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: Trained models, pseudorandom draws and piece search have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last: str | None = None
    for name, stage in STAGES:
        docs, path = support.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            support.delete(spark, last)
        last = path
    return docs
