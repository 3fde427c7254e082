"""Parent-child links to full hierarchies.

The links form a directed graph: several parents per child, repeats, links without one end and cycles all
occur. Persons are numbered once, in the order of their names, so that every round moves two or three numbers a row.
The work is done in four steps:

1. *cycle separation*: rake (drop nodes without incoming or without outgoing links) and compress (a run of nodes with
   one link in and one out becomes one link, found by pointer doubling) until nothing is left or only cores without
   such nodes; those are parted by the least marks that reach a node and that it reaches, until every class is found.
   The runs are then put back in reverse order;
2. *subtree sizes* of the forest of primary parents by pointer doubling;
3. *heavy paths*: every node hands on its chain to the child with the largest subtree; pointer doubling gives
   each node its chain and its position;
4. *intervals*: a root enters chains at (position, depth); from there it owns the rest of the chain. Entries
   travel along the light links only, dominated ones are dropped, and what is left is joined with the chains
   once, so descendants are read off as chain intervals. Chains are cut into stretches for the joins, so that no
   task gets a long chain whole.

Nodes that are done leave the loops, so no round hashes them, or a NULL pointer, to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.relational import with_row_no
from kinweave.runtime import checkpoint, discard

MAX_ROUNDS = 10_000  # a guard against endless loops only; every loop below ends by its own condition
STRETCH = 512  # positions of a chain that are one join key


def clean_links(df: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """Distinct links p -> c with both ends present (not NULL, not the empty string)."""
    out = df.select(F.col(parent).cast("string").alias("p"), F.col(child).cast("string").alias("c"))
    return out.where("p IS NOT NULL AND c IS NOT NULL AND p <> '' AND c <> ''").distinct()


def numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links with numbers for names, and (name, v); numbers go in the order of the names."""
    names = with_row_no(links.select(F.col("p").alias("name")).union(links.select("c")).distinct(), [F.col("name")])
    names = checkpoint(names.select("name", F.col("row_no").cast("long").alias("v")))
    of = lambda end: names.select(F.col("name").alias(end), F.col("v").alias(end + "_no"))
    out = links.join(of("p"), "p").join(of("c"), "c").select(F.col("p_no").alias("p"), F.col("c_no").alias("c"))
    return checkpoint(out), names


def _rake(edges: DataFrame) -> DataFrame:
    """One layer of nodes without a link in, and one of nodes without a link out, are dropped."""
    down = edges.join(edges.select(F.col("c").alias("p")).distinct(), "p", "left_semi")
    return down.join(edges.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("p", "c")


def _runs(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Runs of pass-through nodes: all such nodes (v), (v, p, c) with the ends of v's run, and pure rings (v, scc).

    None if there is no node with one link in and one out. Pointers go up and down at once and double; what is still
    open when a round closes nothing is a ring.
    """
    into = edges.groupBy(F.col("c").alias("v")).agg(F.count("*").alias("n_in"), F.min("p").alias("p"))
    out = edges.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("n_out"), F.min("c").alias("c"))
    thin = checkpoint(into.where("n_in = 1").join(out.where("n_out = 1"), "v").select("v", "p", "c"))
    if thin.isEmpty():
        return None
    both = thin.select(F.lit(0).alias("d"), "v", F.col("p").alias("ptr")).union(thin.select(F.lit(1).alias("d"), "v", F.col("c").alias("ptr")))
    state = checkpoint(both.join(thin.select(F.col("v").alias("ptr"), F.lit(True).alias("open")), "ptr", "left").select("d", "v", "ptr", F.coalesce("open", F.lit(False)).alias("open")))
    closed, n = [state.where("NOT open")], state.where("open").count()
    open_ = state.where("open")
    for _ in range(MAX_ROUNDS):
        if not n:
            break
        known = reduce(DataFrame.union, [open_, *closed])
        far = known.select("d", F.col("v").alias("ptr"), F.col("ptr").alias("far"), F.col("open").alias("more"))
        step = checkpoint(open_.join(far, ["d", "ptr"]).select("d", "v", F.col("far").alias("ptr"), F.col("more").alias("open")))
        closed.append(step.where("NOT open"))
        open_, left = step.where("open"), step.where("open").count()
        if left == n:
            break
        n = left
    # a ring takes the name of its least node: pointers double once more, from one step on, until all have met it
    ring = thin.join(open_.where("d = 0").select("v"), "v", "left_semi").select("v", F.col("p").alias("ptr"), F.col("v").alias("m"))
    for _ in range(MAX_ROUNDS if n else 0):
        far = ring.select(F.col("v").alias("ptr"), F.col("ptr").alias("far"), F.col("m").alias("m2"))
        ring = checkpoint(ring.join(far, "ptr").select("v", F.col("far").alias("ptr"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("moved")))
        if ring.where("moved").isEmpty():
            break
        ring = ring.drop("moved")
    ends = reduce(DataFrame.union, closed)
    cut = ends.where("d = 0").select("v", F.col("ptr").alias("p")).join(ends.where("d = 1").select("v", F.col("ptr").alias("c")), "v")
    return thin.select("v"), checkpoint(cut), ring.select("v", F.col("m").alias("scc"))


def _classes(edges: DataFrame) -> DataFrame | None:
    """Strongly connected classes (v, scc) of two nodes or more; None if there is none.

    Every node learns the least mark among the nodes that reach it and among those it reaches. Where both come from one
    node, that node's class is found; links between nodes that differ in either mark lie on no cycle. What is left is
    raked and marked anew; marks are one-to-one hashes that change from turn to turn.
    """
    done = None
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        nodes = edges.select(F.col("p").alias("v")).union(edges.select("c")).distinct()
        mark = F.xxhash64("v", F.lit(turn))
        state = checkpoint(nodes.select("v", mark.alias("f"), mark.alias("b")))
        for _ in range(MAX_ROUNDS):
            down = edges.join(state.select(F.col("v").alias("p"), "f"), "p").groupBy(F.col("c").alias("v")).agg(F.min("f").alias("f2"))
            up = edges.join(state.select(F.col("v").alias("c"), "b"), "c").groupBy(F.col("p").alias("v")).agg(F.min("b").alias("b2"))
            new = state.join(down, "v", "left").join(up, "v", "left").select("v", F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), (F.coalesce(F.col("f2") < F.col("f"), F.lit(False)) | F.coalesce(F.col("b2") < F.col("b"), F.lit(False))).alias("moved"))
            new = checkpoint(new)
            still = new.where("moved").isEmpty()
            discard(state)
            state = new.select("v", "f", "b")
            if still:
                break
        found = checkpoint(state.where("f = b").select("v", F.col("f").alias("k")))
        root = nodes.select(mark.alias("k"), F.col("v").alias("scc"))
        found = found.join(root, "k").select("v", "scc")
        many = found.groupBy("scc").count().where("count > 1").select("scc")
        found = checkpoint(found.join(many, "scc", "left_semi").select("v", "scc"))
        done = found if done is None else done.union(found)
        at = lambda end: state.select(F.col("v").alias(end), F.col("f").alias("f_" + end), F.col("b").alias("b_" + end))
        rest = edges.join(at("p"), "p").join(at("c"), "c").where("f_p = f_c AND b_p = b_c AND f_p <> b_p").select("p", "c")
        edges = _rake_all(checkpoint(rest))
    return done


def _rake_all(edges: DataFrame) -> DataFrame:
    n = edges.count()
    while n:
        edges = checkpoint(_rake(edges))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def cycle_members(links: DataFrame) -> DataFrame:
    """Nodes (v) that lie on a directed cycle of links (p, c) between numbers, links to oneself included."""
    loops = [links.where("p = c").select(F.col("p").alias("v"), F.col("p").alias("scc"))]
    edges = checkpoint(links.where("p <> c"))
    n = edges.count()
    cuts: list[DataFrame] = []
    while n:
        edges = checkpoint(_rake(edges))
        left, before = edges.count(), n
        n = left
        if not left or left <= 0.6 * before:
            continue
        runs = _runs(edges)  # little to rake: shorten the chains that hold the rest up
        if runs is None:
            if left == before:
                break
            continue
        thin, cut, rings = runs
        cuts.append(cut)
        kept = edges.join(thin.withColumnRenamed("v", "p"), "p", "left_anti").join(thin.withColumnRenamed("v", "c"), "c", "left_anti")
        joined = checkpoint(kept.select("p", "c").union(cut.select("p", "c")).distinct())
        # a run that comes back to where it began closes a cycle of its own
        loops += [rings, joined.where("p = c").select(F.col("p").alias("v"), F.col("p").alias("scc"))]
        edges = checkpoint(joined.where("p <> c"))
        n = edges.count()
        if n > 0.5 * left:  # few runs are left to shorten: what remains is all junctions, near to each other
            break
    cyclic = reduce(DataFrame.union, loops).distinct()
    found = _classes(_rake_all(edges)) if n else None
    known = checkpoint(cyclic if found is None else cyclic.union(found))
    for cut in reversed(cuts):
        # a node of a run is on a cycle if the link that it stood for is: both ends in one class
        back = cut.join(known.select(F.col("v").alias("p"), F.col("scc").alias("a")), "p").join(known.select(F.col("v").alias("c"), F.col("scc").alias("b")), "c").where("a = b")
        known = checkpoint(known.union(back.select("v", F.col("a").alias("scc"))))
    return known.select("v").distinct()


def primary_forest(links: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(v, up): every acyclic node with its primary parent, NULL for the tops of the forest.

    The primary parent is the smallest acyclic one; the other links stay light.
    """
    nodes = links.select(F.col("p").alias("v")).union(links.select("c")).distinct().join(cyclic, "v", "left_anti")
    bad = cyclic.withColumnRenamed("v", "p")
    up = links.join(bad, "p", "left_anti").groupBy(F.col("c").alias("v")).agg(F.min("p").alias("up"))
    return nodes.join(up, "v", "left")


def subtree_sizes(forest: DataFrame) -> DataFrame:
    """(v, up, size): number of nodes of the subtree under v, by pointer doubling.

    Only nodes that still have an ancestor so far up take part in a round; what they hand up is summed in the end.
    """
    state = checkpoint(forest.where("up IS NOT NULL").select("v", F.col("up").alias("ptr"), F.lit(1).cast("long").alias("size")))
    gains = []
    for _ in range(MAX_ROUNDS):
        if state.isEmpty():
            break
        gain = checkpoint(state.groupBy(F.col("ptr").alias("v")).agg(F.sum("size").alias("gain")))
        gains.append(gain)
        jump = state.select(F.col("v").alias("ptr"), F.col("ptr").alias("far"))
        new = checkpoint(state.join(jump, "ptr").join(gain, "v", "left").select("v", F.col("far").alias("ptr"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")))
        discard(state)
        state = new
    if not gains:
        return forest.select("v", "up", F.lit(1).cast("long").alias("size"))
    total = reduce(DataFrame.union, gains).groupBy("v").agg(F.sum("gain").alias("gain"))
    return forest.join(total, "v", "left").select("v", "up", (1 + F.coalesce("gain", F.lit(0))).alias("size"))


def heavy_paths(sized: DataFrame) -> DataFrame:
    """(v, up, size, chain, pos, len): the head of v's heavy path, v's place on it (0 = head) and how many it has."""
    sized = checkpoint(sized)
    heavy = sized.where("up IS NOT NULL").groupBy(F.col("up").alias("ptr")).agg(F.max_by("v", F.struct("size", "v")).alias("v"))
    # a heavy path is a line of nodes: pointers along it meet each node once, whatever the number of its children
    open_ = checkpoint(heavy.select("v", "ptr", F.lit(1).cast("long").alias("pos")))
    first = open_
    closed = []
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            break
        jump = open_.select(F.col("v").alias("ptr"), F.col("ptr").alias("far"), F.col("pos").alias("more"), F.lit(True).alias("open"))
        ends = [c.select(F.col("v").alias("ptr"), F.col("ptr").alias("far"), F.col("pos").alias("more"), F.lit(False).alias("open")) for c in closed]
        step = checkpoint(open_.join(reduce(DataFrame.union, [jump, *ends]), "ptr", "left").select("v", F.coalesce("far", "ptr").alias("ptr"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.coalesce("open", F.lit(False)).alias("open")))
        closed.append(step.where("NOT open").drop("open"))
        open_ = step.where("open").drop("open")
    found = reduce(DataFrame.union, closed) if closed else first
    placed = sized.join(found.select("v", F.col("ptr").alias("chain"), "pos"), "v", "left")
    placed = checkpoint(placed.select("v", "up", "size", F.coalesce("chain", "v").alias("chain"), F.coalesce("pos", F.lit(0).cast("long")).alias("pos")))
    return placed.join(placed.groupBy("chain").agg((F.max("pos") + 1).alias("len")), "chain").select("v", "up", "size", "chain", "pos", "len")


def _stretch(pos: Column | str) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / STRETCH)


def descend(links: DataFrame, chains: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(root, v, depth): fewest links from every root to every node reached from it, cyclic nodes included."""
    one = F.lit(1).cast("long")
    place = checkpoint(chains.select("v", "chain", "pos", "len").union(cyclic.select("v", F.col("v").alias("chain"), F.lit(0).cast("long"), one)))
    at = lambda end, a, b, n: place.select(F.col("v").alias(end), F.col("chain").alias(a), F.col("pos").alias(b), F.col("len").alias(n))
    placed = links.where("p <> c").join(at("p", "chain", "a", "l1"), "p").join(at("c", "to_chain", "to_pos", "to_len"), "c")
    light = checkpoint(placed.where("NOT (chain = to_chain AND to_pos = a + 1)").select("chain", "a", "to_chain", "to_pos", "to_len", _stretch("a").alias("part")))
    roots = links.select(F.col("p").alias("v")).distinct().join(links.select(F.col("c").alias("v")).distinct(), "v", "left_anti")
    entries = checkpoint(roots.join(place, "v").select(F.col("v").alias("root"), "chain", "pos", "len", F.lit(0).cast("long").alias("depth")))
    fresh = entries
    for _ in range(MAX_ROUNDS):
        wide = fresh.withColumn("part", F.explode(F.sequence(_stretch("pos"), _stretch(F.col("len") - 1))))
        step = wide.join(light, ["chain", "part"]).where("a >= pos").select("root", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.col("to_len").alias("len"), (F.col("depth") + F.col("a") - F.col("pos") + 1).alias("depth"))
        # one aggregation for both: map-side it takes the many ways into a place together
        tagged = entries.withColumn("old", F.lit(1)).unionByName(step.withColumn("old", F.lit(0)))
        flat = tagged.groupBy("root", "chain", "pos", "len").agg(F.min(F.struct("depth", (-F.col("old")).alias("age"))).alias("m")).select("root", "chain", "pos", "len", "m.depth", "m.age")
        w = W.partitionBy("root", "chain").orderBy("pos")
        before = F.min(F.col("depth") - F.col("pos")).over(w.rowsBetween(W.unboundedPreceding, -1))
        merged = checkpoint(flat.withColumn("before", before).where("before IS NULL OR depth - pos < before").drop("before"))
        entries = merged.drop("age")
        fresh = merged.where("age = 0").drop("age")
        if fresh.isEmpty():
            break
    w = W.partitionBy("root", "chain").orderBy("pos")
    spans = entries.withColumn("stop", F.coalesce(F.lead("pos").over(w), F.col("len")))
    spans = spans.withColumn("part", F.explode(F.sequence(_stretch("pos"), _stretch(F.col("stop") - 1))))
    nodes = place.select("v", "chain", F.col("pos").alias("at"), _stretch("pos").alias("part"))
    own = spans.join(nodes, ["chain", "part"]).where("at >= pos AND at < stop")
    return own.select("root", "v", (F.col("depth") + F.col("at") - F.col("pos")).cast("int").alias("depth"))


def hierarchy(df: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """(person_id, root_id, depth) for every root and node reached from it, and ('cycle', -1) for nodes on a cycle.

    Links without one end, repeated links and further columns have no effect; an empty table gives no rows. A node
    reached from no root and on no cycle has no row.
    """
    links, names = numbered(clean_links(df, parent, child))
    cyclic = checkpoint(cycle_members(links))
    chains = heavy_paths(subtree_sizes(primary_forest(links, cyclic)))
    reached = descend(links, chains, cyclic).join(cyclic, "v", "left_anti")
    rows = reached.join(names.select("v", F.col("name").alias("person_id")), "v").join(names.select(F.col("v").alias("root"), F.col("name").alias("root_id")), "root").select("person_id", "root_id", "depth")
    return rows.union(cyclic.join(names, "v").select("name", F.lit("cycle").alias("root_id"), F.lit(-1).alias("depth")))


def hierarchy_paths(df: DataFrame, parent: str = "parent_id", child: str = "child_id", sep: str = "/") -> DataFrame:
    """(person_id, root_id, depth, path, n_descendants, chain_id, chain_pos) in the forest of primary parents.

    The path of a node is the path of its chain's parent followed by the chain up to the node, so the number of
    rounds is the number of light links above a node, not the depth. Nodes on a cycle have NULL path and depth -1.
    """
    links, names = numbered(clean_links(df, parent, child))
    cyclic = checkpoint(cycle_members(links))
    chains = heavy_paths(subtree_sizes(primary_forest(links, cyclic)))
    w = W.partitionBy("chain").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    local = checkpoint(chains.join(names, "v").withColumn("segment", F.concat_ws(sep, F.collect_list("name").over(w))).drop("len"))
    heads = local.where("pos = 0").select("chain", F.col("up").alias("above"))
    state = checkpoint(local.join(heads, "chain").select("v", "name", "chain", "pos", "size", "segment", "above", F.col("pos").alias("depth"), F.col("chain").alias("top")))
    link = state.select(F.col("v").alias("above"), F.col("segment").alias("seg2"), F.col("above").alias("above2"), F.col("pos").alias("pos2"), F.col("top").alias("top2"))
    done, open_ = [state.where("above IS NULL")], state.where("above IS NOT NULL")
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            break
        step = checkpoint(
            open_.join(link, "above").select(
                "v", "name", "chain", "pos", "size",
                F.concat_ws(sep, "seg2", "segment").alias("segment"),
                F.col("above2").alias("above"),
                (F.col("depth") + F.col("pos2") + 1).alias("depth"),
                F.col("top2").alias("top"),
            )
        )
        done.append(step.where("above IS NULL"))
        open_ = step.where("above IS NOT NULL")
    state = reduce(DataFrame.unionByName, [d.select("v", "name", "chain", "pos", "size", "segment", "depth", "top") for d in done])
    of = lambda end, name: names.select(F.col("v").alias(end), F.col("name").alias(name))
    state = state.join(of("top", "root_id"), "top").join(of("chain", "chain_id"), "chain")
    rows = state.select(F.col("name").alias("person_id"), "root_id", F.col("depth").cast("int").alias("depth"), F.col("segment").alias("path"), (F.col("size") - 1).alias("n_descendants"), "chain_id", F.col("pos").cast("int").alias("chain_pos"))
    rings = cyclic.join(names, "v")
    return rows.union(rings.select("name", F.lit("cycle"), F.lit(-1), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("int")))
