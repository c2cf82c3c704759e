"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 1).

DataFrame operations only. Each paragraph is hashed to a wide vector and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two. So the order of
paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its
vector. A paragraph's vector has two parts:

- ``LANES32`` lanes of 32 bits hashed from the whole paragraph: equal sums mean equal multisets;
- ``LANES16`` lanes of 16 bits to which each short piece of the paragraph adds +1 or -1 at one
  lane: the cosine of two such sums estimates that of the multisets of pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NEWLINE, stored, table, text_or_empty

LANES32 = 8
LANES16 = 128
#: Markers that are looked up together.
STEP = 16
#: Pieces start anew at each sentence and paragraph. The last of a sentence may be short and has
#: the marks that end it, so every character of a paragraph is in one piece.
PIECE = r"[^\n.!?]{1,16}[.!?]*|[.!?]+"
MOD32 = (1 << 32) - 1


def exact_lanes(text: Column) -> Column:
    """Sums modulo 2^32 of the hashes of all paragraphs. Each pair of lanes is one pass over the
    paragraph from a seed of its own, so what collides in one pair doesn't in the others."""
    zero = F.array(*[F.lit(0).cast("long")] * LANES32)

    def add(acc: Column, paragraph: Column) -> Column:
        hashed = [F.xxhash64(F.lit(i), paragraph) for i in range(LANES32 // 2)]
        lanes = [x for h in hashed for x in (h.bitwiseAND(MOD32), F.shiftrightunsigned(h, 32))]
        return F.array(*[(acc[i] + lane).bitwiseAND(MOD32) for i, lane in enumerate(lanes)])

    return F.aggregate(F.split(text, NEWLINE), zero, add)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece_lanes(text: Column) -> Column:
    """Signed counts of pieces by lane. The codes of all pieces (lane and sign) are sorted
    together with a marker for each code; the markers' places give the counts. They are looked
    up in two steps: every ``STEP``th marker among all, the others between those."""
    codes = F.transform(
        F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)),
        lambda p: F.pmod(F.xxhash64(p), F.lit(2 * LANES16)).cast("int"),
    )
    marks = F.sequence(F.lit(0), F.lit(2 * LANES16))
    groups, steps = F.sequence(F.lit(0), F.lit(2 * LANES16 // STEP)), F.sequence(F.lit(0), F.lit(STEP - 1))
    lanes = F.sequence(F.lit(0), F.lit(LANES16 - 1))

    def within(s: Column, tops: Column, g: Column) -> Column:
        part = F.slice(s, F.get(tops, g), F.get(tops, g + 1) - F.get(tops, g))
        return _let(part, lambda x: F.transform(steps, lambda k: F.array_position(x, g * STEP + k).cast("int") + F.get(tops, g)))

    def places(s: Column) -> Column:
        return _let(
            F.transform(groups, lambda g: F.array_position(s, g * STEP).cast("int")),
            lambda tops: F.concat(
                F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2 * LANES16 // STEP - 1)), lambda g: within(s, tops, g))),
                F.array(F.get(tops, F.lit(2 * LANES16 // STEP)) + 1),
            ),
        )

    return _let(
        F.sort_array(F.concat(codes, marks)),
        lambda s: _let(
            places(s),
            lambda at: F.transform(lanes, lambda k: F.get(at, 2 * k + 1) * 2 - F.get(at, 2 * k) - F.get(at, 2 * k + 2)),
        ),
    )


def as_hex(exact: Column, lanes: Column) -> Column:
    """All lanes as fixed-width hexadecimal digits: the sums modulo 2^32 and modulo 2^16."""
    wide = F.transform(exact, lambda x: F.lpad(F.hex(x), 8, "0"))
    narrow = F.transform(lanes, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << 16))), 4, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(narrow, "")))


def likeness(exact: Column, lanes: Column, exact2: Column, lanes2: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the lanes of pieces, from 0 up."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    size = F.sqrt(dot(lanes, lanes) * dot(lanes2, lanes2))
    cosine = F.when(size > 0, dot(lanes, lanes2) / size).otherwise(0.0)
    return F.when((exact == exact2) & (lanes == lanes2), 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def next_ids(sizes: DataFrame) -> DataFrame:
    """``doc_id, n_chars, next_id`` from ``doc_id, n_chars``: the next smaller distinct id; after
    the smallest comes the largest. Ranges of ids are looked through in tasks of their own, and
    only one row for each range meets in a single task. Of repeated ids the longest text counts."""
    ranged = sizes.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars")).repartitionByRange("doc_id")
    # Written, since two evaluations could draw the ranges differently.
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    by_range = Window.orderBy("range")
    every = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    ends = ends.select(
        F.col("range").alias("range_"),
        F.coalesce(F.lag("top").over(by_range), F.max("top").over(every)).alias("below"),
    )
    inside = F.lag("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))
    # One row for each range, as many as there are shuffle partitions.
    found = ranged.withColumn("inside", inside).join(F.broadcast(ends), F.col("range") == F.col("range_"))
    return found.select("doc_id", "n_chars", F.coalesce("inside", "below").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, text, n_chars, exact, lanes``; a null text counts as empty. Other
    columns are ignored; repeated rows are kept; an empty table gives an empty one."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
        exact_lanes(F.col("text")).alias("exact"),
        piece_lanes(F.col("text")).alias("lanes"),
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the
    next document, and how like they are. Of repeated ids the smallest start serves as the next
    document. A row with a null id is a document of its own, which is its own next and no
    other's. Null and empty texts are alike; very long ones are hashed whole. Other columns are
    ignored, whatever their names; an empty table gives an empty one.

    Texts are moved once, and only the starts that are wanted a second time: both uses of ``base``
    ask for the same two columns without a filter, so Spark makes one exchange of them.
    """
    prints = fingerprints(docs, id_col, text_col)
    # Nameless rows are dealt by their text.
    base = prints.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), F.array(F.struct("*")).alias("rows")
    ).repartition("key")
    row = F.get("rows", F.lit(0))
    text = text_or_empty(text_col)
    sizes = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"))
    links = next_ids(sizes).select("doc_id", "next_id", F.floor(F.col("n_chars") / 3).cast("int").alias("want"))

    def next_of(r: Column) -> Column:
        found = F.struct(F.left(r["text"], F.col("want")).alias("start"), r["exact"].alias("exact"), r["lanes"].alias("lanes"))
        return F.when(r["doc_id"].isNotNull(), found)

    # Within a lambda, so that whole rows are asked for and the exchange stays the same.
    next_ = F.get(F.transform("rows", next_of), F.lit(0))
    starts = (
        links.withColumnRenamed("doc_id", "before").join(base, F.col("next_id") == F.col("key"))
        .groupBy("before").agg(F.min(next_).alias("next"))
    )
    joined = base.join(starts, F.col("key") == F.col("before"), "left").select(row.alias("own"), "next")
    alone = F.struct(F.col("own.text").alias("start"), "own.exact", "own.lanes")
    joined = joined.select("own.*", F.when(F.col("own.doc_id").isNull(), alone).otherwise(F.col("next")).alias("next"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next.start", third))
    hashed = joined.withColumn("edited", edited).withColumns(
        {"edited_exact": exact_lanes(F.col("edited")), "edited_lanes": piece_lanes(F.col("edited"))}
    )
    own = F.col("exact"), F.col("lanes")
    return hashed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(*own).alias("fingerprint"),
        as_hex(F.col("edited_exact"), F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(*own, F.col("edited_exact"), F.col("edited_lanes")).alias("near_edited"),
        likeness(*own, F.col("next.exact"), F.col("next.lanes")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
