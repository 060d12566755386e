"""A training corpus from documents: rules, line dedup, near duplicates, mixing, and piece ids.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents. An empty table passes every stage as an empty table; further columns stay, whatever
their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import line_dedup, mixing, ngram_join, piece_codec, quality_rules
from freshet.llm.tables import materialize, read_table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Null, empty and short texts have fewer than fifty words and go. Null languages and sources are groups of their own, null ids and repeated rows are judged like others, each for itself.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated passages; a document of which no word is left goes.

    The first occurrence is that of the smallest id. Rows with a null id or text stay as they are; rows equal in id and text are one document and each get its text. ``n_chars``
    follows the text. What is left of a copy stays, however short.
    """
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~F.coalesce(emptied, F.lit(False))).select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles at 0.8 or more.

    Rows without words and rows with a null id stay; of rows equal in id and text one stays; rows that share an id but not the text are told apart.
    """
    return ngram_join.keep_one(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattens the shares of the sources: every document once, those of smaller sources up to 1.5 times on average.

    A null source is the source "". Null and empty texts count one token. Rows with equal ids are repeated together.
    """
    return mixing.mix_sources(docs).select("row.*")


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, decoded again and compared.

    A null text is coded as the empty text; null ids and repeated rows each give a row.
    """
    return piece_codec.round_trip(docs, public_tokenizers.path(piece_codec.MODEL))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard_join", near), ("mix_sources", mix), ("sentencepiece", ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
