"""Kin graphs: adjacency, time-gated neighbourhoods and what is measured in them.

A graph is a table of directed adjacency rows (s, t); an undirected link has both. Neighbourhoods are built ring by
ring for all seeds at once: each ring is one join of the last ring with the adjacency and one anti-join with what was
seen, and is written before the next, so plans stay short and a lost executor costs one ring at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.relational import set_sizes, with_row_no
from kinweave.runtime import checkpoint, discard


def build_graph(parents: DataFrame, spouses: DataFrame, persons: DataFrame | None = None, multigraph: bool = False) -> DataFrame:
    """(s, t) in both directions from parent and spouse links (OP-160). Loops and NULL or empty ends are dropped; with
    persons only links between known ids stay. A multigraph keeps parallel links, a simple one doesn't."""
    p = parents.select(F.col("parent_id").alias("s"), F.col("child_id").alias("t")).distinct()
    w = spouses.select(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("t")).distinct()
    e = p.union(w).where("s IS NOT NULL AND t IS NOT NULL AND s <> '' AND t <> '' AND s <> t")
    if persons is not None:
        ids = persons.select(F.col("id").alias("s")).distinct()
        e = e.join(ids, "s", "left_semi").join(ids.withColumnRenamed("s", "t"), "t", "left_semi").select("s", "t")
    both = e.union(e.select("t", "s"))
    return both if multigraph else both.distinct()


def active_subgraph(adj: DataFrame, persons: DataFrame, lo: int, hi: int) -> DataFrame:
    """Links induced on persons alive in [lo, hi] and their direct kin (OP-161); isolated persons vanish."""
    live = persons.where((F.col("birth") <= hi) & (F.col("death") >= lo)).select("id").distinct()
    near = adj.join(live.withColumnRenamed("id", "s"), "s", "left_semi").select(F.col("t").alias("id"))
    keep = live.union(near).distinct()
    return adj.join(keep.withColumnRenamed("id", "s"), "s", "left_semi").join(keep.withColumnRenamed("id", "t"), "t", "left_semi").where("s <> t").select("s", "t").distinct()


def gated_ball(seeds: DataFrame, adj: DataFrame, births: DataFrame | None, hops: int) -> DataFrame:
    """(seed, role, cutoff, node, depth) of all nodes within so many links of each seed (OP-162 to OP-165, OP-172).

    seeds: (seed, role, node, cutoff) - node is where the walk starts, cutoff the year every further node must be born
    before; births: (id, birth); with births = None nothing is gated. The start itself isn't gated, a node without a
    birth is never entered.
    """
    if births is None:
        step_to = adj.select(F.col("s").alias("node"), F.col("t"), F.lit(None).cast("int").alias("b"))
    else:
        step_to = adj.join(births.select(F.col("id").alias("t"), F.col("birth").alias("b")).where("birth IS NOT NULL"), "t").select(F.col("s").alias("node"), "t", "b")
    step_to = checkpoint(step_to.distinct())
    ring = checkpoint(seeds.select("seed", "role", "cutoff", "node", F.lit(0).alias("depth")).distinct())
    rings = [ring]
    for d in range(1, hops + 1):
        nxt = ring.join(step_to, "node")
        if births is not None:
            nxt = nxt.where("b < cutoff")
        nxt = nxt.select("seed", "role", "cutoff", F.col("t").alias("node")).distinct()
        seen = reduce(DataFrame.union, rings).select("seed", "role", "node")
        ring = checkpoint(nxt.join(seen, ["seed", "role", "node"], "left_anti").select("seed", "role", "cutoff", "node", F.lit(d).alias("depth")))
        if ring.isEmpty():
            break
        rings.append(ring)
    return reduce(DataFrame.union, rings)


def plain_seeds(df: DataFrame, seed: str = "id", cutoff: Column | None = None, role: str = "ego") -> DataFrame:
    return df.select(F.col(seed).alias("seed"), F.lit(role).alias("role"), F.col(seed).alias("node"), (cutoff if cutoff is not None else F.lit(None)).cast("int").alias("cutoff"))


def reach(ball: DataFrame, labels: DataFrame, hops: list[int], include_ego: bool = True) -> DataFrame:
    """Per seed and role: distinct labels and nodes (ego not counted) within each number of links (OP-163, OP-164, OP-156)."""
    lab = labels.select(F.col("id").alias("node"), F.col("label"))
    inner = ball.join(lab, "node", "left")
    own = F.lit(True) if include_ego else F.col("depth") > 0
    cols: list[Column] = []
    for h in hops:
        cols += [F.count_distinct(F.when((F.col("depth") <= h) & own, F.col("label"))).alias(f"reach_{h}"), F.count_if((F.col("depth") <= h) & (F.col("depth") > 0)).alias(f"nodes_{h}")]
    return inner.groupBy("seed", "role").agg(*cols)


def degrees(adj: DataFrame, births: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(id, degree): rows of the adjacency, parallel links counted; with births and seeds only neighbours born before
    the cutoff (OP-116, pre-degree)."""
    if births is None:
        return adj.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("degree"))
    j = seeds.select(F.col("seed").alias("s"), "cutoff").distinct().join(adj, "s").join(births.select(F.col("id").alias("t"), "birth"), "t")
    return j.where("birth < cutoff").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("degree"))


def role_seeds(persons: DataFrame, kin: DataFrame) -> DataFrame:
    """Seeds of a person and of mother, father and mother's father, each walk gated by the person's birth (the person's
    own by death + 1) (OP-165). kin: (child_id, father_id, mother_id, mgf_id)."""
    ego = persons.select(F.col("id").alias("seed"), F.lit("ego").alias("role"), F.col("id").alias("node"), (F.col("death") + 1).cast("int").alias("cutoff"))
    j = kin.join(persons.select(F.col("id").alias("child_id"), "birth"), "child_id")
    roles = [j.where(f"{c} IS NOT NULL").select(F.col("child_id").alias("seed"), F.lit(r).alias("role"), F.col(c).alias("node"), F.col("birth").cast("int").alias("cutoff")) for r, c in (("mother", "mother_id"), ("father", "father_id"), ("mgf", "mgf_id"))]
    return reduce(DataFrame.union, [ego, *roles]).where("cutoff IS NOT NULL")


def reach_increment(ball: DataFrame, labels: DataFrame, hop: int, a: str = "father", b: str = "mother") -> DataFrame:
    """Per seed the labels reached through role a only, b only, both, either (OP-103, OP-167)."""
    lab = labels.where("label IS NOT NULL").select(F.col("id").alias("node"), "label")
    sets = ball.where(F.col("depth") <= hop).where(F.col("role").isin(a, b)).join(lab, "node").groupBy("seed").agg(F.collect_set(F.when(F.col("role") == a, F.col("label"))).alias("A"), F.collect_set(F.when(F.col("role") == b, F.col("label"))).alias("B"))
    return sets.select("seed", *set_sizes(F.col("A"), F.col("B")))


def cohesion(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, deg, hhi, clustering): concentration of the neighbours' labels and the share of neighbours linked to each
    other, for a simple graph (OP-137, OP-166). NULL where undefined.

    Triangles are counted from the end of smaller degree, so that a hub never emits the square of its links.
    """
    lab = labels.where("label IS NOT NULL").select(F.col("id").alias("t"), "label")
    shares = adj.join(lab, "t").groupBy("s", "label").agg(F.count("*").alias("n"))
    hhi = shares.groupBy("s").agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))
    deg = adj.groupBy("s").agg(F.count("*").alias("deg"))
    d2 = deg.select(F.col("s").alias("t"), F.col("deg").alias("deg_t"))
    up = checkpoint(adj.join(deg, "s").join(d2, "t").where("struct(deg, s) < struct(deg_t, t)").select("s", "t"))
    wedge = up.select("s", F.col("t").alias("x")).join(up.select("s", F.col("t").alias("y")), "s").where("x < y")
    both = up.select(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"))
    tri = wedge.join(both, ["x", "y"])
    per = tri.select(F.explode(F.array("s", "x", "y")).alias("s")).groupBy("s").agg(F.count("*").alias("tri"))
    out = deg.join(hhi, "s", "left").join(per, "s", "left")
    return out.select(F.col("s").alias("id"), "deg", "hhi", F.when(F.col("deg") >= 2, F.coalesce("tri", F.lit(0)) * 2.0 / (F.col("deg") * (F.col("deg") - 1))).alias("clustering"))


def breadth(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, breadth): distinct labels of the direct neighbours (OP-195)."""
    return adj.join(labels.where("label IS NOT NULL").select(F.col("id").alias("t"), "label"), "t").groupBy(F.col("s").alias("id")).agg(F.count_distinct("label").alias("breadth"))


def peer_stats(ball: DataFrame, features: DataFrame, flags: list[str], values: list[str]) -> DataFrame:
    """Per seed: number of peers in the ball (ego excluded), share with each flag, mean of each value (OP-168, OP-169);
    NULL where nothing is known. A flag may itself depend on the cutoff: give a column event_year and the flag
    'event_year' is true where it lies before the cutoff."""
    peers = ball.where("depth > 0").join(features.withColumnRenamed("id", "node"), "node", "left")
    share = lambda f: F.avg(F.when(F.lit(True), F.coalesce((F.col(f) < F.col("cutoff")) if f == "event_year" else F.col(f).cast("boolean"), F.lit(False)).cast("int"))).alias(f"share_{f}")
    return peers.groupBy("seed", "role").agg(F.count("*").alias("n_peers"), *[share(f) for f in flags], *[F.avg(v).alias(f"mean_{v}") for v in values])


def band_exposures(ball: DataFrame, features: DataFrame, value: str, bands: list[tuple[int, int]], cap: int = 10) -> DataFrame:
    """Per seed and band of distances: peers, mean value, count of peers with a value above zero, the same capped (OP-170)."""
    peers = ball.where("depth > 0").join(features.select(F.col("id").alias("node"), F.col(value).alias("v")), "node", "left")
    cols: list[Column] = []
    for lo, hi in bands:
        inside = F.col("depth").between(lo, hi)
        n = F.count_if(inside & (F.col("v") > 0))
        cols += [F.count_if(inside).alias(f"n_{lo}_{hi}"), F.avg(F.when(inside, F.col("v"))).alias(f"mean_{lo}_{hi}"), n.alias(f"with_{lo}_{hi}"), F.least(n, F.lit(cap)).alias(f"capped_{lo}_{hi}")]
    return peers.groupBy("seed", "role").agg(*cols)


def ring_profile(ball: DataFrame, features: DataFrame, value: str, profile: DataFrame) -> DataFrame:
    """Per seed the mean of ring means weighted by a profile (depth, weight) (OP-149b, OP-170)."""
    rings = ball.where("depth > 0").join(features.select(F.col("id").alias("node"), F.col(value).alias("v")), "node").groupBy("seed", "depth").agg(F.avg("v").alias("m"))
    j = rings.join(profile, "depth").where("m IS NOT NULL")
    return j.groupBy("seed").agg((F.sum(F.col("m") * F.col("weight")) / F.sum("weight")).alias("weighted"))


def gated_distance(pairs: DataFrame, adj: DataFrame, births: DataFrame, cap: int = 15) -> DataFrame:
    """(a, b, year, distance): fewest links from a to b through nodes born before the year, b too; cap + 1 if none (OP-173).

    All pairs advance together; a pair that has met its end leaves the frontier.
    """
    base = checkpoint(pairs.select("a", "b", "year").distinct())
    step_to = checkpoint(adj.join(births.select(F.col("id").alias("t"), F.col("birth").alias("birth")).where("birth IS NOT NULL"), "t").select("s", "t", "birth").distinct())
    ring = checkpoint(base.select("a", "b", "year", F.col("a").alias("node")))
    seen = ring
    found = base.where("a = b").select("a", "b", "year", F.lit(0).alias("distance"))
    ring = ring.where("a <> b")
    hits = [found]
    for d in range(1, cap + 1):
        nxt = ring.join(step_to, ring["node"] == step_to["s"]).where("birth < year").select("a", "b", "year", F.col("t").alias("node")).distinct()
        nxt = checkpoint(nxt.join(seen, ["a", "b", "year", "node"], "left_anti"))
        if nxt.isEmpty():
            break
        met = checkpoint(nxt.where("node = b").select("a", "b", "year", F.lit(d).alias("distance")))
        hits.append(met)
        ring = nxt.join(met, ["a", "b", "year"], "left_anti")
        seen = seen.union(nxt)
    got = reduce(DataFrame.union, hits)
    return base.join(got, ["a", "b", "year"], "left").select("a", "b", "year", F.coalesce("distance", F.lit(cap + 1)).alias("distance"))


def propagate_labels(adj: DataFrame, anchors: DataFrame, depth: int = 6) -> DataFrame:
    """(id, label, depth): the nearest anchor's label; of equally near ones the label with most anchors, then the smaller
    label, then the smaller anchor (OP-174). anchors: (id, label)."""
    size = anchors.groupBy("label").agg(F.count("*").alias("k"))
    best = checkpoint(anchors.join(size, "label").select("id", F.struct((-F.col("k")).alias("k"), "label", F.col("id").alias("anchor")).alias("r")).groupBy("id").agg(F.min("r").alias("r")).withColumn("depth", F.lit(0)))
    ring = best
    for d in range(1, depth + 1):
        nxt = ring.join(adj.withColumnRenamed("s", "id"), "id").groupBy(F.col("t").alias("id")).agg(F.min("r").alias("r"))
        ring = checkpoint(nxt.join(best, "id", "left_anti").withColumn("depth", F.lit(d)))
        if ring.isEmpty():
            break
        best = best.union(ring)
    return best.select("id", F.col("r.label").alias("label"), "depth")


def bilineal_extension(labels: DataFrame, kin: DataFrame, max_passes: int = 30) -> DataFrame:
    """(id, label, pass): persons without a label take the father's, else the mother's, pass by pass (OP-175).

    Synchronous: a pass sees the labels of the pass before. kin: (child_id, father_id, mother_id).
    """
    known = checkpoint(labels.where("label IS NOT NULL").select("id", "label", F.lit(0).alias("pass")))
    for n in range(1, max_passes + 1):
        open_ = kin.join(known.select(F.col("id").alias("child_id")), "child_id", "left_anti")
        f = known.select(F.col("id").alias("father_id"), F.col("label").alias("lf"))
        m = known.select(F.col("id").alias("mother_id"), F.col("label").alias("lm"))
        got = open_.join(f, "father_id", "left").join(m, "mother_id", "left").select(F.col("child_id").alias("id"), F.coalesce("lf", "lm").alias("label"), F.lit(n).alias("pass")).where("label IS NOT NULL")
        got = checkpoint(got.groupBy("id").agg(F.min("label").alias("label"), F.first("pass").alias("pass")))
        if got.isEmpty():
            break
        known = known.union(got)
    return known


def patrilines(fathers: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(id, label): components of father-child links, numbered PL0, PL1 ... by their smallest member, or by the smallest
    row_no of order (id, row_no) (OP-177)."""
    comp = checkpoint(connected_components(fathers, "father_id", "child_id"))
    if order is not None:
        first = comp.join(order, comp["node"] == order["id"]).groupBy("component").agg(F.min("row_no").alias("k"))
    else:
        first = comp.select("component").distinct().withColumn("k", F.col("component"))
    numbered = with_row_no(first, [F.col("k"), F.col("component")]).select("component", F.col("row_no").alias("n"))
    return comp.join(numbered, "component").select(F.col("node").alias("id"), F.concat(F.lit("PL"), F.col("n")).alias("label"))


def quotient_graph(spouses: DataFrame, labels: DataFrame, births: DataFrame | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(a, b, w): marriages between groups, those within a group dropped; with births only couples whose mean birth lies
    in [lo, hi] (OP-178)."""
    e = spouses.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if births is not None:
        e = e.join(births.select(F.col("id").alias("a"), F.col("birth").alias("ba")), "a").join(births.select(F.col("id").alias("b"), F.col("birth").alias("bb")), "b").where((F.col("ba") + F.col("bb")) / 2 >= lo).where((F.col("ba") + F.col("bb")) / 2 <= hi).select("a", "b")
    la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return e.join(la, "a").join(lb, "b").where("la <> lb").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity, n_communities) of a partition (id, label) of weighted undirected edges (a, b, w) (OP-182)."""
    j = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    total = j.agg(F.sum("w").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0)).alias("inside"))
    ends = j.select(F.explode(F.array("la", "lb")).alias("l"), "w").groupBy("l").agg(F.sum("w").alias("d"))
    sq = ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("sq"), F.count("*").alias("n_communities"))
    return total.crossJoin(sq).select((F.col("inside") / F.col("total") - F.col("sq") / (4.0 * F.col("total") * F.col("total"))).alias("modularity"), "n_communities")  # one row each


def induced_window(adj: DataFrame, births: DataFrame, lo: int, hi: int, min_share: float = 0.0) -> DataFrame:
    """Links (a < b) between persons born in [lo, hi) whose component has at least min_share of those with a link (OP-183)."""
    keep = births.where((F.col("birth") >= lo) & (F.col("birth") < hi)).select("id")
    e = checkpoint(adj.where("s < t").join(keep.withColumnRenamed("id", "s"), "s", "left_semi").join(keep.withColumnRenamed("id", "t"), "t", "left_semi").select(F.col("s").alias("a"), F.col("t").alias("b")).distinct())
    if min_share <= 0:
        return e
    comp = checkpoint(connected_components(e))
    n = comp.count()
    big = comp.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") >= F.ceil(F.lit(min_share * n)))
    ok = comp.join(big, "component", "left_semi").select(F.col("node").alias("a"))
    return e.join(ok, "a", "left_semi")


def spanning_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: edges, those between communities, their share (OP-184)."""
    j = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return j.agg(F.count("*").alias("edges"), F.count_if(F.col("la") != F.col("lb")).alias("spanning")).withColumn("share", F.when(F.col("edges") > 0, F.col("spanning") / F.col("edges")))


def pedigree_uniqueness(parents: DataFrame, focal: DataFrame, depth: int = 7, min_slots: int = 6) -> DataFrame:
    """(id, slots, ancestors, index): weighted share of distinct ancestors among the ancestor slots (OP-186).

    A slot d generations up weighs 2^-d; an ancestor counts once, at the nearest generation. Multiplicities are summed
    as they go, so that repeated lines never multiply rows.
    """
    up = checkpoint(parents.select(F.col("child_id").alias("node"), F.col("parent_id").alias("up")).where("node IS NOT NULL AND up IS NOT NULL AND node <> '' AND up <> '' AND node <> up").distinct())
    level = checkpoint(focal.select("id", F.col("id").alias("node"), F.lit(1).cast("long").alias("mult")).distinct())
    levels = []
    for d in range(1, depth + 1):
        level = checkpoint(level.join(up, "node").groupBy("id", F.col("up").alias("node")).agg(F.sum("mult").alias("mult")))
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(d)))
    if not levels:
        return focal.select("id", F.lit(0).cast("long").alias("slots"), F.lit(0).cast("long").alias("ancestors"), F.lit(None).cast("double").alias("index")).limit(0)
    per = reduce(DataFrame.union, levels).groupBy("id", "node").agg(F.min("depth").alias("first"), F.sum("mult").alias("m"), F.sum(F.col("mult") * F.pow(F.lit(2.0), -F.col("depth"))).alias("w"))
    return per.groupBy("id").agg(F.sum("m").alias("slots"), F.count("*").alias("ancestors"), (F.sum(F.pow(F.lit(2.0), -F.col("first"))) / F.sum("w")).alias("index")).where(F.col("slots") >= min_slots)


def male_line(fathers: DataFrame, focal: DataFrame, values: DataFrame, generations: int = 6) -> DataFrame:
    """(id, length, total, total_above): the line of fathers, how long, the sum of a value with and without the father
    (OP-187). fathers: (child_id, father_id); values: (id, value)."""
    hop = fathers.where("father_id IS NOT NULL").select(F.col("child_id").alias("node"), F.col("father_id").alias("up"))
    level = focal.select("id", F.col("id").alias("node"))
    levels = []
    for d in range(1, generations + 1):
        level = checkpoint(level.join(hop, "node").select("id", F.col("up").alias("node")))
        levels.append(level.withColumn("gen", F.lit(d)))
    line = reduce(DataFrame.union, levels).join(values.select(F.col("id").alias("node"), "value"), "node", "left")
    sums = line.groupBy("id").agg(F.max("gen").alias("length"), F.sum("value").alias("total"), F.sum(F.when(F.col("gen") > 1, F.col("value"))).alias("total_above"))
    return focal.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("length", "total", "total_above")])


def male_line_descendants(roots: DataFrame, children: DataFrame, excluded: DataFrame | None = None, max_depth: int = 30) -> DataFrame:
    """(root, node, depth): descendants through males; daughters are leaves, excluded persons are cut with all below
    them (OP-075, OP-188). children: (parent_id, child_id, parent_sex)."""
    hop = children.where("parent_sex = 'M'").select(F.col("parent_id").alias("node"), "child_id").distinct()
    if excluded is not None:
        hop = hop.join(excluded.select(F.col("id").alias("child_id")), "child_id", "left_anti")
    hop = checkpoint(hop)
    level = checkpoint(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct())
    seen = level.withColumn("depth", F.lit(0))
    for d in range(1, max_depth + 1):
        level = checkpoint(level.join(hop, "node").select("root", F.col("child_id").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.union(level.withColumn("depth", F.lit(d)))
    return seen


def line_status(descendants: DataFrame, persons: DataFrame, focal: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(id, males, alive, unknown, status): whether the male line of a root is extinct at a time t: 'extinct' if every
    male is recorded dead before t, 'open' if one is recorded alive at t, else 'unknown'; 'empty' without males. Rulings
    (id, status) override (OP-189). focal: (id, t)."""
    p = persons.select(F.col("id").alias("node"), "sex", "birth", "death")
    j = descendants.where("depth > 0").withColumnRenamed("root", "id").join(focal, "id").join(p, "node").where("sex = 'M'")
    agg = j.groupBy("id").agg(F.count("*").alias("males"), F.count_if((F.col("death") >= F.col("t")) & (F.col("birth") < F.col("t"))).alias("alive"), F.count_if(F.col("death").isNull()).alias("unknown"))
    out = focal.select("id").join(agg, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("males", "alive", "unknown")])
    status = F.when(F.col("males") == 0, "empty").when(F.col("alive") > 0, "open").when(F.col("unknown") > 0, "unknown").otherwise("extinct")
    out = out.withColumn("status", status)
    if rulings is not None:
        out = out.join(rulings.select("id", F.col("status").alias("ruled")), "id", "left").withColumn("status", F.coalesce("ruled", "status")).drop("ruled")
    return out


def conflict_flags(kin: DataFrame, persons: DataFrame, spouses: DataFrame, focal: DataFrame) -> DataFrame:
    """(id, h1, h2, h3, any): the mother's father married twice or more; he left no son but a daughter other than the
    mother who had a son; he had a brother alive at the person's birth (OP-190). kin: (child_id, father_id, mother_id, mgf_id)."""
    sex = persons.select("id", "sex", "birth", "death")
    couples = spouses.select("a", "b").union(spouses.select("b", "a")).distinct().groupBy(F.col("a").alias("mgf_id")).agg(F.count("*").alias("n_spouses"))
    kids = kin.where("father_id IS NOT NULL").select(F.col("father_id").alias("mgf_id"), F.col("child_id").alias("kid")).join(sex.select(F.col("id").alias("kid"), F.col("sex").alias("kid_sex")), "kid")
    sons = kids.groupBy("mgf_id").agg(F.count_if(F.col("kid_sex") == "M").alias("n_sons"))
    mothers = kin.where("mother_id IS NOT NULL").join(sex.select(F.col("id").alias("child_id"), F.col("sex").alias("s")), "child_id").where("s = 'M'").select(F.col("mother_id").alias("kid")).distinct()
    daughters = kids.where("kid_sex = 'F'").join(mothers, "kid").select("mgf_id", "kid")
    base = focal.select("id").join(kin.withColumnRenamed("child_id", "id"), "id").where("mgf_id IS NOT NULL").select("id", "mother_id", "mgf_id").join(sex.select("id", F.col("birth").alias("B")), "id")
    sister = base.join(daughters, "mgf_id").where("kid <> mother_id").groupBy("id").agg(F.lit(1).alias("sister_son"))
    gp = kin.select(F.col("child_id").alias("mgf_id"), F.col("father_id").alias("ggf"))
    bros = kin.where("father_id IS NOT NULL").select(F.col("father_id").alias("ggf"), F.col("child_id").alias("bro")).join(sex.select(F.col("id").alias("bro"), F.col("sex").alias("bs"), F.col("birth").alias("bb"), F.col("death").alias("bd")), "bro").where("bs = 'M'")
    brother = base.join(gp, "mgf_id").join(bros, "ggf").where("bro <> mgf_id AND bb < B AND bd >= B").groupBy("id").agg(F.lit(1).alias("brother"))
    out = base.join(couples, "mgf_id", "left").join(sons, "mgf_id", "left").join(sister, "id", "left").join(brother, "id", "left")
    h1 = (F.coalesce("n_spouses", F.lit(0)) >= 2).cast("int")
    h2 = ((F.coalesce("n_sons", F.lit(0)) == 0) & F.col("sister_son").isNotNull()).cast("int")
    h3 = F.coalesce("brother", F.lit(0))
    return out.select("id", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), F.greatest(h1, h2, h3).alias("any"))


def siblings(parents: DataFrame) -> DataFrame:
    """(a, b) distinct ordered pairs of co-children (OP-193); as large as the families are."""
    p = parents.where("parent_id IS NOT NULL AND child_id IS NOT NULL AND parent_id <> '' AND child_id <> ''").select("parent_id", "child_id").distinct()
    return p.select("parent_id", F.col("child_id").alias("a")).join(p.select("parent_id", F.col("child_id").alias("b")), "parent_id").where("a <> b").select("a", "b").distinct()


def sibling_counts(parents: DataFrame) -> DataFrame:
    """(id, n_siblings): distinct co-children (OP-116), counted by family, without pairs of siblings."""
    links = parents.where("parent_id IS NOT NULL AND child_id IS NOT NULL AND parent_id <> '' AND child_id <> ''").select("parent_id", "child_id").distinct()
    family, members = sibling_sets(links)
    size = members.groupBy("family").agg((F.count("*") - 1).alias("n_siblings"))
    return family.join(size, "family").where("n_siblings > 0").select(F.col("child_id").alias("id"), "n_siblings")


def ego_network(adj: DataFrame, seed: str, hops: int, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, label) and induced edges of one person's neighbourhood (OP-194)."""
    spark = adj.sparkSession
    ball = checkpoint(gated_ball(spark.createDataFrame([(seed, "ego", seed, None)], "seed string, role string, node string, cutoff int"), adj, None, hops))
    nodes = ball.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select("node", "depth", "label")
    keep = ball.select("node")
    edges = adj.where("s < t").join(keep.withColumnRenamed("node", "s"), "s", "left_semi").join(keep.withColumnRenamed("node", "t"), "t", "left_semi").distinct()
    return nodes, edges


def event_years(events: DataFrame, person: str, year: str, kinds: dict[str, Column], lo: int, hi: int) -> DataFrame:
    """(id, first_year, first_<kind>, in_window) per person (OP-171, OP-196)."""
    cols = [F.min(F.when(c, F.col(year))).alias(f"first_{k}") for k, c in kinds.items()]
    return events.where(F.col(person).isNotNull()).groupBy(F.col(person).alias("id")).agg(F.min(year).alias("first_year"), *cols, F.coalesce(F.bool_or(F.col(year).between(lo, hi)), F.lit(False)).cast("int").alias("in_window"))


def sibling_sets(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child_id, family) and (family, member): children of the same set of parents share a family, whose members are all
    children of any of these parents. Linear in the families, where pairs of siblings would be quadratic."""
    from kinweave.operators.fill import set_key

    links = parents.select("parent_id", "child_id").distinct()
    own = checkpoint(set_key(links, "child_id", "parent_id", "family").withColumnRenamed("id", "child_id"))
    heads = own.join(links, "child_id").select("family", "parent_id").distinct()
    members = heads.join(links, "parent_id").select("family", F.col("child_id").alias("member")).distinct()
    return own, checkpoint(members)


def impute_years(persons: DataFrame, parents: DataFrame, spouses: DataFrame, passes: int = 20, gap_m: int = 30, gap_f: int = 25, life: int = 60, spouse_gap: int = 3, late: int = 25) -> DataFrame:
    """(id, birth, death, birth_imputed, death_imputed, round) by synchronous rounds over kin (OP-191).

    A missing year is the rounded median of all that kin give, in every round for both years. Birth: of each parent its
    birth plus the gap of its sex, or else its death less a life plus the gap; of each child its birth less the own gap,
    or else its death less a life and the gap; of each spouse its birth, less or plus spouse_gap where a man has a wife
    or a woman a husband; own death less a life; the median of the siblings' births. Death: own birth plus a life;
    spouses' deaths; the median of the siblings' deaths; parents' deaths plus late; children's births plus a life less
    gap_m. Values are never revised; a round sees the values of the one before, a death also the birth of its own round.
    Flags are 1 for imputed, 0 for observed, NULL for still missing; it ends when a round adds nothing, or after passes
    rounds.
    """
    gap = lambda s: F.when(F.col(s) == "M", float(gap_m)).when(F.col(s) == "F", float(gap_f)).otherwise((gap_m + gap_f) / 2)
    clean = parents.select("parent_id", "child_id").where("parent_id IS NOT NULL AND child_id IS NOT NULL AND parent_id <> child_id").distinct()
    sex = persons.select(F.col("id").alias("parent_id"), F.col("sex").alias("ps"))
    links = checkpoint(clean.join(sex, "parent_id"))
    family, members = sibling_sets(clean)
    wed = spouses.select("a", "b").union(spouses.select("b", "a")).where("a <> b").distinct()
    of = lambda c, s: persons.select(F.col("id").alias(c), F.col("sex").alias(s))
    wed = checkpoint(wed.join(of("a", "sa"), "a").join(of("b", "sb"), "b"))
    step = F.when((F.col("sa") == "M") & (F.col("sb") == "F"), -spouse_gap).when((F.col("sa") == "F") & (F.col("sb") == "M"), spouse_gap).otherwise(0)
    state = checkpoint(persons.select("id", F.col("birth").cast("int").alias("birth"), F.col("death").cast("int").alias("death"), F.lit(0).alias("round")))
    start = persons.select("id", F.col("birth").alias("b0"), F.col("death").alias("d0"))
    middle = lambda c: F.bround(F.median(c)).cast("int")
    gaps = lambda df: df.agg(F.count_if(F.col("birth").isNull()) + F.count_if(F.col("death").isNull())).first()[0]
    n = gaps(state)
    for r in range(1, passes + 1):
        if not n:
            break
        s = state.select("id", "birth", "death").where("birth IS NOT NULL OR death IS NOT NULL")
        up = links.join(s.withColumnRenamed("id", "parent_id"), "parent_id")
        down = links.join(s.withColumnRenamed("id", "child_id"), "child_id")
        mate = wed.join(s.withColumnRenamed("id", "b"), "b")
        brood = members.join(s.withColumnRenamed("id", "member"), "member").groupBy("family").agg(middle("birth").alias("birth"), middle("death").alias("death"))
        kin = [
            up.select(F.col("child_id").alias("id"), F.coalesce("birth", F.col("death") - life).alias("y"), gap("ps").alias("g"), (F.col("death") + late).alias("d")),
            down.select(F.col("parent_id").alias("id"), F.coalesce("birth", F.col("death") - life).alias("y"), (-gap("ps")).alias("g"), (F.col("birth") + life - gap_m).alias("d")),
            mate.select(F.col("a").alias("id"), F.col("birth").alias("y"), step.cast("double").alias("g"), F.col("death").alias("d")),
            family.join(brood, "family").select(F.col("child_id").alias("id"), F.col("birth").alias("y"), F.lit(0.0).alias("g"), F.col("death").alias("d")),
            s.select("id", (F.col("death") - life).alias("y"), F.lit(0.0).alias("g"), F.lit(None).cast("int").alias("d")),
        ]
        open_ = state.where("birth IS NULL OR death IS NULL").select("id")
        given = checkpoint(reduce(DataFrame.union, kin).join(open_, "id", "left_semi").select("id", (F.col("y") + F.col("g")).cast("int").alias("e"), "d"))
        births = given.groupBy("id").agg(middle("e").alias("e"))
        half = checkpoint(state.join(births, "id", "left").withColumn("birth", F.coalesce("birth", "e")).drop("e"))
        deaths = half.where("death IS NULL AND birth IS NOT NULL").select("id", (F.col("birth") + life).alias("d")).union(given.select("id", "d")).groupBy("id").agg(middle("d").alias("d"))
        new = half.join(deaths, "id", "left").join(state.select("id", F.col("birth").alias("b1"), F.col("death").alias("d1")), "id")
        new = new.withColumn("death", F.coalesce("death", "d"))
        moved = ~(F.col("birth").eqNullSafe(F.col("b1")) & F.col("death").eqNullSafe(F.col("d1")))
        new = checkpoint(new.select("id", "birth", "death", F.when(moved, r).otherwise(F.col("round")).alias("round")))
        discard(state, given, half)
        state = new
        left = gaps(state)
        if left == n:
            break
        n = left
    out = state.join(start, "id")
    flag = lambda now, old: F.when(F.col(now).isNull(), None).otherwise(F.col(old).isNull().cast("int"))
    return out.select("id", "birth", "death", flag("birth", "b0").alias("birth_imputed"), flag("death", "d0").alias("death_imputed"), "round")


def edge_controlled(series: DataFrame, y: str, n: str, cubic: bool = False) -> DataFrame:
    """series with y_adj: residual of y on log(n) (or its cubic) plus the mean of y (OP-185). One row per window."""
    d = series.withColumn("__x", F.log(F.col(n).cast("double")))
    if not cubic:
        c = d.agg(F.regr_slope(y, "__x").alias("__b"), F.regr_intercept(y, "__x").alias("__a"), F.avg(y).alias("__m"))
        return d.crossJoin(c).withColumn(y + "_adj", F.col(y) - F.col("__a") - F.col("__b") * F.col("__x") + F.col("__m")).drop("__x", "__a", "__b", "__m")  # one row
    from kinweave.operators.econ import residualize

    d = d.withColumn("__x2", F.col("__x") ** 2).withColumn("__x3", F.col("__x") ** 3)
    res = residualize(d, [y], ["__x", "__x2", "__x3"], [])
    return res.crossJoin(d.agg(F.avg(y).alias("__m"))).withColumn(y + "_adj", F.col(y + "_res") + F.col("__m")).drop("__x", "__x2", "__x3", "__m", y + "_res")
