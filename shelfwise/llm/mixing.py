"""Mixing sources to target weights.

1. One aggregate gives the words of each source.
2. Targets: sources in code-point order (NULL last) weigh ``weights`` in turn and share ``share`` of all words. No
   target exceeds ``cap`` times its source's words; the excess goes to the others by weight until none is above. That
   fixed point is ``min(cap * words, level * weight)``, and ``level`` comes from prefix sums over the sources in order
   of ``words / weight``: no iteration, one row per source.
3. A document is emitted ``floor(rate)`` times, ``rate = target / words of its source``, plus once more when a hash of
   (seed, doc_id) falls below the fraction. The hash is SHA-256, so reruns agree on every machine.

The table of sources has one row per source and is joined by Spark's own choice of join (adaptive execution splits a
hot source). NULL and empty texts have size 0; a source without words has target 0. Repeated rows with one doc_id get
the same decision each; a NULL doc_id draws as the text 'null'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
CAP = 2
SEED = "mix-1"
_HEX = 12


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.size(words_of(text_of(text))).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: ``__source``, ``__words`` and ``__target``, from rows of (``__source``, ``__size``)."""
    per_source = sized.groupBy("__source").agg(F.sum("__size").alias("__words"))
    in_order = Window.orderBy(F.col("__source").asc_nulls_last())
    # Windows without a key: over one row per source, never over documents.
    ranked = per_source.withColumn("__at", (F.row_number().over(in_order) - 1) % len(weights))
    ranked = ranked.withColumn("__weight", F.element_at(F.lit(list(weights)), F.col("__at") + 1).cast("long"))
    ratio = F.col("__words") / F.col("__weight")
    by_ratio = Window.orderBy(ratio.asc(), F.col("__source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("__words").over(Window.partitionBy())
    # What is left for this source and those after it when all before it are at their caps, times share[1].
    rest = share[0] * total - share[1] * cap * F.coalesce(F.sum("__words").over(before), F.lit(0))
    ranked = ranked.withColumn("__rest", rest).withColumn("__open", F.sum("__weight").over(onwards))
    ranked = ranked.withColumn("__capped", share[1] * cap * F.col("__words") * F.col("__open") <= F.col("__rest") * F.col("__weight"))
    # The first source below its cap fixes the level for all from there on.
    first = F.min(F.when(~F.col("__capped"), F.struct(ratio.alias("r"), F.col("__source").isNull().alias("n"), F.col("__source").alias("s"), "__rest", "__open"))).over(Window.partitionBy())
    ranked = ranked.withColumn("__first", first)
    level = F.col("__weight") * F.col("__first")["__rest"] / (share[1] * F.col("__first")["__open"])
    return ranked.select(
        "__source",
        "__words",
        F.when(F.col("__capped"), cap * F.col("__words").cast("double")).otherwise(level).alias("__target"),
    )


def draw(id_col: str | Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of (seed, id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(key, 256), 1, _HEX), 16, 10).cast("long") / F.lit(float(16**_HEX))


def with_sizes(docs: DataFrame, text_col="text", source_col="source") -> DataFrame:
    """All rows and columns with ``__size`` and ``__source``."""
    return docs.withColumn("__size", size_of(F.col(text_col))).withColumn("__source", F.col(source_col))


def mix_plan(sized: DataFrame, id_col="doc_id", seed: str = SEED, **table) -> DataFrame:
    """All rows and columns of ``with_sizes`` with ``__words``, ``__target`` and ``__copies``."""
    targets = source_targets(sized.select("__source", "__size"), **table).withColumnRenamed("__source", "__of")
    rate = F.when(F.col("__words") > 0, F.col("__target") / F.col("__words")).otherwise(F.lit(0.0))
    extra = (draw(id_col, seed) < rate - F.floor(rate)).cast("long")
    return (
        sized.join(targets, F.col("__source").eqNullSafe(F.col("__of")))
        .withColumn("__copies", F.floor(rate) + extra)
        .drop("__of")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as the plan says, columns unchanged."""
    planned = mix_plan(with_sizes(docs), **options).filter("__copies > 0")
    copies = planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return copies.select(docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every row."""
    # Texts are read once: the plan needs their sizes twice.
    sized = with_sizes(docs.select("doc_id", "text", "source")).select("doc_id", "__source", "__size")
    plan = mix_plan(Scratch(docs.sparkSession, "mixing").store(sized), **options)
    return plan.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__words").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )
