"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import checkpoint, discard


def _mark(edges: DataFrame) -> tuple:
    """Number and two order-free hash sums of a set of edges."""
    h = lambda seed: F.xxhash64("u", "v", F.lit(seed))
    return tuple(edges.agg(F.count("*"), F.bit_xor(h(1)), F.sum(F.pmod(h(2), F.lit(2**31)))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component, for all nodes with an edge.

    Large-star and small-star rounds (a logarithmic number of them) never gather a component in one place. NULL ends
    are dropped, repeated edges and loops have no effect, an empty table gives no rows.
    """
    src = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = src.where("u = v").select(F.col("u").alias("node")).distinct()
    # every edge points from the larger node to the smaller one
    state = checkpoint(src.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(state)
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpoint(large)
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = checkpoint(small)
        discard(large, state)
        state, last, mark = small, mark, _mark(small)
        if mark == last:  # nothing moved
            break
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return out.union(loops.join(out, "node", "left_anti").select("node", F.col("node").alias("component")))
