"""From raw documents to packed sequences in five stages.

Each stage gets what the one before wrote, works on all of it, and is written in turn, so a lost
executor costs no more than the tasks that ran there. All but the last return the columns of the
documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidewise.llm import language_id, line_dedup, mixing, near_dedup, packing
from sidewise.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that stands out go: null, empty and blank texts, texts without
    a letter, and texts scored below the least score. Rows with a null language aren't learned
    from, rows with a null id neither, but both are judged by their text; equal rows fare alike.
    Texts and all other columns stay as they are."""
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents share; ``n_chars`` follows. No row goes: a text
    that loses all lines becomes empty, and so does a null text. Rows that share an id count as
    one document but lose lines of their own text only; rows with a null id lose none."""
    out = line_dedup.drop_shared_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id. Empty and
    blank texts are like nothing and stay. Rows that repeat the id that stays all stay; rows with
    a null id are documents of their own and stay."""
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that share an
    id, null too, are taken alike, as often as the one of them that is taken most. Texts without
    words add nothing to a source's size; a null source is a source of its own."""
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    copies = copies.withColumnRenamed("doc_id", "__id")
    repeated = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences. A null or empty text is a piece that holds
    the end id; rows that share an id, null too, are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language models, tokenizers and knapsacks have no SQL; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
