"""Labelling helpers: searched CASE chains and bucketizers as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching ``(condition, label)`` wins; ``default`` otherwise (NULL if None).

    A NULL condition counts as not matched, as in SQL ``CASE WHEN``.
    """
    if not rules:
        raise ValueError("classify needs at least one rule")
    expr = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, label in rules[1:]:
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def first_match(conditions: Sequence[Column], labels: Sequence[str]) -> Column:
    """``labels[i]`` for the first true ``conditions[i]``; the one extra last label is the default."""
    if len(labels) != len(conditions) + 1:
        raise ValueError("need one more label than conditions (the default)")
    return classify(list(zip(conditions, labels[:-1])), labels[-1])


def threshold_labels(
    col: str | Column, table: Sequence[tuple[float, str]], default: str, op: str = ">="
) -> Column:
    """Label by the first threshold that ``col`` passes (``op`` is ``>=``, ``>`` or ``<=``)."""
    c = F.col(col) if isinstance(col, str) else col
    test = {">=": c.__ge__, ">": c.__gt__, "<=": c.__le__}[op]
    return classify([(test(F.lit(t)), label) for t, label in table], default)


def bucketize(
    col: str | Column,
    edges: Sequence[float],
    labels: Sequence[str],
    right_closed: bool = False,
    lower_bound: float | None = None,
) -> Column:
    """Label ``col`` by ordered ``edges``.

    Left-closed (default): ``x < e0 -> labels[0]``, ``x < e1 -> labels[1]``, ...,
    else the last label (``len(labels) == len(edges) + 1``).

    Right-closed with ``lower_bound``: ``(lower_bound, e0] -> labels[0]``, ...,
    ``> e_last -> labels[-1]``; values ``<= lower_bound`` or NULL get NULL
    (``pandas.cut`` semantics).
    """
    c = F.col(col) if isinstance(col, str) else col
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than edges")
    if not right_closed:
        rules = [(c < F.lit(e), lab) for e, lab in zip(edges, labels)]
        return classify(rules, labels[-1])
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    if lower_bound is not None:
        expr = expr.when(c <= F.lit(lower_bound), F.lit(None).cast("string"))
    for e, lab in zip(edges, labels):
        expr = expr.when(c <= F.lit(e), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def ordinal(col: str | Column, labels: Sequence[str]) -> Column:
    """1-based position of ``col`` in ``labels`` (NULL when absent), for ordering."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, lab in enumerate(labels, start=1):
        expr = F.when(c == F.lit(lab), F.lit(i)) if expr is None else expr.when(c == F.lit(lab), F.lit(i))
    return expr
