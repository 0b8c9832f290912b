"""Running totals per key that survive hot keys.

Each key is cut into pieces by a monotone expression of its order, such as the day. Totals are
summed per piece, carried forward over the short list of pieces, and enter each piece as one row
before its own. A hot key is thus spread over its pieces, and the way is the same at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], piece: Column
) -> DataFrame:
    """Add, for each ``name: value``, the total of ``value`` over the key's earlier rows.

    ``piece`` never falls as ``order`` rises. ``order`` should be unique within a key; rows that tie
    come in any order. Use exact types (integers, decimals): totals then do not depend on how rows
    were partitioned. The first row of a key gets 0, and so does a null key's: it is a key like any other.
    """
    named = df.withColumns({**{f"_v_{n}": v for n, v in values.items()}, "_piece": piece})
    types = {n: named.schema[f"_v_{n}"].dataType for n in values}
    totals = named.groupBy(*keys, "_piece").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_piece",
        *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).cast(t).alias(f"_v_{n}") for n, t in types.items()],
    )
    rows = named.withColumn("_own", F.lit(True)).unionByName(
        carry.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    inside = (
        Window.partitionBy(*keys, "_piece").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, -1)
    )
    added = rows.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in values}).filter("_own")
    return added.select(*df.columns, *values)
