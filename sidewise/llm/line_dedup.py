"""Removal of lines that many documents share (operator 4). DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NEWLINE, SPACE_CHARS, ascii_lower, hash128, stored, table, text_or_empty

MIN_DOCS = 3
MIN_CHARS = 20


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Per document ``doc_id, n_lines, n_dropped, kept`` and ``row``, its input row.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that are found in at least ``min_docs`` documents lose all their
    lines except in the largest document id that holds them. Null or empty: one empty line.
    Repeated ids count as one document, but each row loses lines of its own text only. Rows with
    a null id count as one document that keeps all its lines. Very long texts are split whole.
    Columns other than the two are carried in ``row``, whatever their names. An empty table gives
    an empty one.

    Lines travel as two 64-bit hashes and are split and hashed once. Documents are counted in two
    steps, so that a line found everywhere meets only as partial counts; the join back is one of
    two written tables, which Spark can split at a hot key. A text moves once, inside ``row``, and
    only texts that lose lines are split again.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row"))
    text = text_or_empty(F.col("row")[text_col])
    source = source.withColumn("of", F.xxhash64(text))
    lines = source.select("doc_id", "of", F.posexplode(F.split(text, NEWLINE)).alias("pos", "line"))
    keys = lines.select("doc_id", "of", "pos", ascii_lower(F.btrim("line", F.lit(SPACE_CHARS))).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars)
    h1, h2 = hash128(F.col("key"))
    keys = stored(keys.select("doc_id", "of", "pos", h1.alias("h1"), h2.alias("h2")), "line-keys")
    shared = (
        keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    )
    dropped = (
        keys.join(stored(shared, "shared-lines"), ["h1", "h2"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "of").agg(F.collect_set("pos").alias("drop"))
    )
    lines = F.split(text, NEWLINE)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(NEWLINE), F.lit("")))
    return source.join(dropped, ["doc_id", "of"], "left").select(
        "doc_id",
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), text)
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), NEWLINE))
        .alias("kept"),
        "row",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_shared_lines(docs).drop("row")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (WHERE keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key GROUP BY k.doc_id
"""
