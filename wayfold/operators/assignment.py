"""Optimal one-to-one assignment of gated candidates, split by what can touch what.

Candidates below the gate are links between left and right rows. Rows that no chain of links joins cannot compete, so each
connected component is solved on its own, by a task that holds that component and nothing else; the components come from
label spreading over the whole table. The solution brings its dual prices along: a row's price plus a column's price is
nowhere above the cost of a pair and the prices add up to the total, which proves it optimal without solving it again
(``certificate``).

Cases: null costs and costs at or beyond the gate are no links; repeated pairs count with their least cost; null keys form
one group; an empty table gives no rows. A component itself is one task: its size is bounded by the gate, not by the code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected
from .matching import solve
from .store import durable

Names = Sequence[str]


def _components(links: DataFrame, keys: Names) -> DataFrame:
    """Links (keys, pi, gi, cost) with the number of their component."""
    g = [f"_k{i}" for i in range(len(keys))]
    named = links.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\\N")).alias(c) for k, c in zip(keys, g)], *keys, "pi", "gi", "cost")
    # left rows even, right rows odd
    ends = named.select(*g, (F.col("pi") * 2).alias("a"), (F.col("gi") * 2 + 1).alias("b")).distinct()
    nodes = ends.select(*g, F.explode(F.array("a", "b")).alias("node")).distinct()
    found = connected(ends, nodes, g).select(*g, (F.col("node") / 2).cast("bigint").alias("pi"), "component", (F.col("node") % 2).alias("odd")).filter("odd = 0").drop("odd")
    return named.join(found, [*g, "pi"])


def assigned(pairs: DataFrame, keys: Names, gate: float) -> DataFrame:
    """(keys, component, pi, gi, cost, left_price, right_price): chosen pairs with both prices, and each row that stays alone
    with its own price and nulls for the rest."""
    cols = pairs.select(*keys, "pi", "gi", F.col("cost").cast("double").alias("cost")).filter(F.col("cost") < gate)
    links = durable(cols.groupBy(*keys, "pi", "gi").agg(F.min("cost").alias("cost")))
    parts = _components(links, keys)
    fields = [links.schema[k] for k in keys]
    shape = T.StructType([*fields, T.StructField("component", T.LongType()), T.StructField("pi", links.schema["pi"].dataType), T.StructField("gi", links.schema["gi"].dataType), T.StructField("cost", T.DoubleType()), T.StructField("left_price", T.DoubleType()), T.StructField("right_price", T.DoubleType())])

    def one(x: pd.DataFrame) -> pd.DataFrame:
        left, a = np.unique(x["pi"].to_numpy(), return_inverse=True)
        right, b = np.unique(x["gi"].to_numpy(), return_inverse=True)
        alone = gate * (min(len(left), len(right)) + 1)  # beyond any sum of real costs
        cost = np.full((len(left), len(right)), alone)
        cost[a, b] = x["cost"].to_numpy()
        chosen, u, v = solve(cost)
        real = [(i, j) for i, j in chosen if cost[i, j] < alone]
        lone = sorted(set(range(len(left))) - {i for i, _ in real}), sorted(set(range(len(right))) - {j for _, j in real})
        rows = [(left[i], right[j], cost[i, j], u[i], v[j]) for i, j in real] + [(left[i], None, None, u[i], None) for i in lone[0]] + [(None, right[j], None, None, v[j]) for j in lone[1]]
        out = pd.DataFrame(rows, columns=["pi", "gi", "cost", "left_price", "right_price"]).astype({"pi": "Int64", "gi": "Int64"})
        for k in keys:
            out[k] = x[k].iloc[0]
        return out.assign(component=x["component"].iloc[0])[[f.name for f in shape]]

    return parts.groupBy(*[f"_k{i}" for i in range(len(keys))], "component").applyInPandas(one, shape)


def gated_assignment(pairs: DataFrame, keys: Names, gate: float) -> DataFrame:
    """(keys, pi, gi, cost): as many pairs below the gate as possible, at least total cost."""
    return assigned(pairs, keys, gate).filter("pi is not null and gi is not null").select(*keys, "pi", "gi", "cost")


def certificate(pairs: DataFrame, solution: DataFrame, keys: Names, gate: float, tolerance: float = 1e-3) -> DataFrame:
    """For each group: rows used twice, candidates cheaper than their prices, and components whose prices do not add up to
    their cost (a row without partner costs more than all pairs). All zero: the solution is feasible and no other is better."""
    twice = solution.filter("pi is not null").groupBy(*keys, "pi").count().select(*keys, (F.col("count") > 1).alias("bad"))
    twice = twice.unionByName(solution.filter("gi is not null").groupBy(*keys, "gi").count().select(*keys, (F.col("count") > 1).alias("bad")))
    price = lambda c, p: solution.filter(f"{c} is not null").select(*keys, c, p)
    links = pairs.select(*keys, "pi", "gi", F.col("cost").cast("double").alias("c")).filter(F.col("c") < gate)
    cheap = links.join(price("pi", "left_price"), [*keys, "pi"], "left").join(price("gi", "right_price"), [*keys, "gi"], "left")
    cheap = cheap.select(*keys, F.coalesce(F.col("left_price") + F.col("right_price") > F.col("c") + tolerance, F.lit(True)).alias("bad"))
    n = F.least(F.count("pi"), F.count("gi"))
    alone = gate * (n + 1)
    sums = solution.groupBy(*keys, "component").agg((F.sum(F.coalesce("left_price", F.lit(0.0))) + F.sum(F.coalesce("right_price", F.lit(0.0)))).alias("dual"), (F.coalesce(F.sum("cost"), F.lit(0.0)) + alone * (n - F.count("cost"))).alias("primal"))
    uneven = sums.select(*keys, (F.abs(F.col("dual") - F.col("primal")) > tolerance).alias("bad"))
    tagged = None
    for name, part in (("n_twice", twice), ("n_cheaper", cheap), ("n_uneven", uneven)):
        p = part.select(*keys, F.lit(name).alias("what"), "bad")
        tagged = p if tagged is None else tagged.unionByName(p)
    return tagged.groupBy(*keys).agg(*[F.count_if((F.col("what") == c) & F.col("bad")).alias(c) for c in ("n_twice", "n_cheaper", "n_uneven")])
