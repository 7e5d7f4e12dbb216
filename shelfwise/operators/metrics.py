"""Model metrics as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ranking import group_row_number


def rank_auc(df: DataFrame, score: str, label: str, id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, exactly: the Mann-Whitney rank sum with tied ranks.

    Rows are numbered by score in range partitions (a hot group spans many); rows of one score share the mean of their numbers.
    ``label`` is 0 or 1, rows without score or label are ignored. NULL where a group lacks one of the labels.
    """
    rows = df.select(*keys, F.col(score).alias("_s"), F.col(label).cast("bigint").alias("_y"), F.col(id_col).alias("_i"))
    numbered = group_row_number(rows.where("_s IS NOT NULL AND _y IS NOT NULL"), list(keys), [F.col("_s").asc(), F.col("_i").asc()], "_n")
    ties = numbered.groupBy(*keys, "_s").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.sum("_y").alias("pos"), F.count("_y").alias("n"))
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    sums = ties.groupBy(*keys).agg(
        whole((F.col("first") + F.col("last")).cast("decimal(19,0)") * F.col("pos")).alias("twice"), whole(F.col("pos")).alias("p"), whole(F.col("n") - F.col("pos")).alias("q")
    )
    p, q = F.col("p"), F.col("q")
    return sums.select(*keys, F.when((p > 0) & (q > 0), (F.col("twice") - p * (p + 1)) / (2 * p * q)).alias("auc"))
