"""Contiguous blocks of rows by an integer key, of about equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles that the driver holds at most; further splits between them are by interpolation.
QUANTILES = 10_000
NULLS_LAST = (1 << 63) - 1


def range_block(df: DataFrame, key: str, rows_per_block: int, alone: tuple[int, ...] = ()) -> tuple[Column, int, list[int]]:
    """A column that deals the key's ranges to blocks numbered in key order, their number, and their inner bounds.

    Null keys count as the largest. Equal keys share a block; each key of ``alone`` has
    one to itself. The driver gets at most QUANTILES numbers. An empty table has one block.
    """
    k = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULLS_LAST))
    n = df.count()
    wanted = max(1, -(-n // rows_per_block))
    coarse = min(wanted, QUANTILES)
    cuts: list[int] = []
    if coarse > 1:
        steps = [i / coarse for i in range(coarse + 1)]
        cuts = sorted(set(df.select(F.percentile_approx(k, steps, 2 * QUANTILES)).first()[0]))
    inner = sorted({*cuts[1:-1], *alone, *(x + 1 for x in alone if x < NULLS_LAST)})
    if not inner:
        return F.lit(0), 1, []
    width = max(1, int(len(inner) ** 0.5))
    groups = [inner[i : i + width] for i in range(0, len(inner), width)]
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    table = F.array(*(F.array(*(F.lit(x).cast("long") for x in g)) for g in groups))
    top = F.size(F.filter(heads, lambda x: x <= k))
    at = F.when(top == 0, F.lit(0)).otherwise((top - 1) * width + F.size(F.filter(F.get(table, top - 1), lambda x: x <= k)))
    fine = -(-wanted // coarse)
    if fine == 1:
        return at.cast("int"), len(inner) + 1, inner
    bounds = F.array(*(F.lit(x).cast("double") for x in [*cuts[:1], *inner, *cuts[-1:]]))
    low, high = F.get(bounds, at), F.get(bounds, at + 1)
    sub = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((k - low) * fine / F.greatest(high - low, F.lit(1.0)))))
    return (at * fine + sub).cast("long"), (len(inner) + 1) * fine, inner
