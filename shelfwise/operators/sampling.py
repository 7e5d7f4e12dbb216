"""Reproducible sampling and splitting, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.schema import PRODUCT_ID, SEED


# Lehmer (MINSTD) multiplier and modulus: a portable pseudo-random order that
# any SQL engine computes exactly in 64-bit integers.
_MINSTD_A = 48271
_MINSTD_M = 2147483647


# Steps of the keys of splits and folds: one step leaves small ids in order, three spread them over the whole range.
_SPLIT_STEPS, _FOLD_STEPS = 3, 4


def hash_key(id_col: str = PRODUCT_ID, seed: int = SEED, steps: int = 1) -> Column:
    """A fixed pseudo-random key per row: ``((id mod M) * A + seed) mod M`` (MINSTD), ``steps`` times."""
    c = F.col(id_col).cast("bigint") % F.lit(_MINSTD_M)
    for _ in range(steps):
        c = (c * F.lit(_MINSTD_A) + F.lit(seed)) % F.lit(_MINSTD_M)
    return c


def hash_key_sql(id_col: str = PRODUCT_ID, seed: int = SEED, steps: int = 1) -> str:
    """The same key as SQL text (for an oracle)."""
    c = f"CAST({id_col} AS BIGINT) % {_MINSTD_M}"
    for _ in range(steps):
        c = f"(({c}) * {_MINSTD_A} + {seed}) % {_MINSTD_M}"
    return c


def hash_sample(df: DataFrame, n: int, id_col: str = PRODUCT_ID, seed: int = SEED) -> DataFrame:
    """``n`` rows chosen by hash order (``min(n, count)`` rows); the sample is the feature.

    Planned as TakeOrderedAndProject: each task keeps its own best ``n``, so at
    most ``n * tasks`` rows reach the final merge.
    """
    return df.orderBy(hash_key(id_col, seed), F.col(id_col)).limit(n)


def hash_split(
    df: DataFrame, fraction: float, id_col: str = PRODUCT_ID, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split by the portable key of the id (same rows for any partitioning and any engine)."""
    first = in_train(fraction, id_col, seed)
    return df.where(first), df.where(~first)


def in_train(fraction: float, id_col: str = PRODUCT_ID, seed: int = SEED) -> Column:
    """Whether a row is in the training part."""
    return hash_key(id_col, seed, _SPLIT_STEPS) < F.lit(int(fraction * _MINSTD_M))


def in_train_sql(fraction: float, id_col: str = PRODUCT_ID, seed: int = SEED) -> str:
    """The same test as SQL text (for an oracle)."""
    return f"({hash_key_sql(id_col, seed, _SPLIT_STEPS)}) < {int(fraction * _MINSTD_M)}"


def fold_of(folds: int, id_col: str = PRODUCT_ID, seed: int = SEED) -> Column:
    """The row's cross-validation fold."""
    return (hash_key(id_col, seed, _FOLD_STEPS) % F.lit(folds)).cast("int")


def fold_sql(folds: int, id_col: str = PRODUCT_ID, seed: int = SEED) -> str:
    """The same fold as SQL text (for an oracle)."""
    return f"CAST(({hash_key_sql(id_col, seed, _FOLD_STEPS)}) % {folds} AS INTEGER)"
