import random
from collections import defaultdict

import pytest

from kinweave.operators.hierarchy import clean_links, cycle_members, hierarchy, hierarchy_paths, numbered


def brute(links):
    e = {(a, b) for a, b in links if a and b}
    ch, par = defaultdict(set), defaultdict(set)
    for a, b in e:
        ch[a].add(b)
        par[b].add(a)
    nodes = {x for p in e for x in p}

    def walk(s):
        d, front, n = {}, [s], 0
        while front:
            n += 1
            front = [c for v in front for c in ch.get(v, ()) if c not in d and not d.__setitem__(c, n)]
        return d

    cyc = {v for v in nodes if v in walk(v)}
    out = {(v, "cycle", -1) for v in cyc}
    for r in nodes:
        if not par.get(r):
            out |= {(v, r, d) for v, d in ({r: 0} | walk(r)).items() if v not in cyc}
    return out


def run(spark, links):
    df = spark.createDataFrame([(a, b, 1) for a, b in links], "parent_id string, child_id string, depth int")
    rows = [tuple(r) for r in hierarchy(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


CASES = {
    "empty": [],
    "gaps": [(None, "a"), ("a", None), ("", "b"), ("b", "")],
    "repeats": [("a", "b"), ("a", "b"), ("b", "c")],
    "loop": [("a", "a")],
    "loop below a root": [("r", "a"), ("a", "a"), ("a", "b")],
    "ring without a root": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")],
    "through a ring": [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "x"), ("x", "y"), ("r", "y")],
    "two parents": [("a", "c"), ("b", "c"), ("c", "d"), ("a", "d")],
    "two rings joined": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("r", "a"), ("d", "z")],
    "ring with chords": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("b", "x"), ("x", "d"), ("e", "y"), ("y", "a"), ("x", "leaf"), ("r", "y")],
    "rings that touch": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("f", "g"), ("g", "e"), ("g", "g"), ("r", "a"), ("f", "leaf")],
    "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)],
    "long ring": [(f"n{i:03d}", f"n{(i + 1) % 17:03d}") for i in range(17)] + [("r", "n000"), ("n005", "leaf")],
}


@pytest.mark.parametrize("name", ["empty", "gaps"])
def test_no_links(spark, name):
    assert run(spark, CASES[name]) == set()


def test_small(spark):
    """All cases side by side, as families of one table."""
    links = [(a and f"{name}:{a}", b and f"{name}:{b}") for name in CASES for a, b in CASES[name]]
    assert run(spark, links) == brute(links)


def ladder(n, rng):
    """Two rails with rungs both ways: a core without a single pass-through node, its nodes in random order."""
    ids = [f"k{i:03d}" for i in rng.sample(range(1000), 2 * n)]
    a, b = ids[:n], ids[n:]
    rails = [(r[i], r[(i + 1) % n]) for r in (a, b) for i in range(n)]
    return rails + list(zip(a, b, strict=True)) + list(zip(b, a, strict=True))


def cores(name):
    rng = random.Random(len(name))
    if name == "ladder":
        return ladder(6, rng)
    if name == "ladders in a row":
        one, two = ladder(4, rng), [(f"z{a}", f"z{b}") for a, b in ladder(4, rng)]
        return one + two + [(one[0][0], two[0][0]), ("r", one[0][0]), (two[3][0], "leaf"), ("r", "leaf")]
    nodes = [f"d{i:02d}" for i in range(30)]
    return [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)]


def test_cores(spark):
    links = [(f"{name}:{a}", f"{name}:{b}") for name in ("ladder", "ladders in a row", "dense random") for a, b in cores(name)]
    assert run(spark, links) == brute(links)


def test_one_parent_of_half_the_links(spark):
    links = [("hub", f"c{i:04d}") for i in range(1500)] + [(f"c{i:04d}", f"g{i:04d}") for i in range(1400)] + [("top", "hub")]
    assert run(spark, links) == brute(links)


def test_long_chain_with_many_entries(spark):
    """A chain over several stretches that several roots enter at several places."""
    links = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1300)] + [(f"r{i}", f"n{i * 130:04d}") for i in range(10)] + [("r3", "n0100"), ("r3", "n1100")]
    assert run(spark, links) == brute(links)


def test_cycle_members_are_numbers(spark):
    links, names = numbered(clean_links(spark.createDataFrame(CASES["long ring"], "parent_id string, child_id string")))
    assert [r["name"] for r in names.orderBy("v").collect()] == sorted({x for p in CASES["long ring"] for x in p})
    assert cycle_members(links).count() == 17


def test_random(spark):
    rng = random.Random(5)
    links = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(45)] + [(f"t{i // 3}", f"t{i + 1}") for i in range(60)]
    assert run(spark, links) == brute(links)


def test_paths(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("x", "x")], "parent_id string, child_id string")
    rows = {r["person_id"]: r for r in hierarchy_paths(df).collect()}
    assert rows["d"]["path"] == "a/b/d" and rows["d"]["depth"] == 2 and rows["d"]["root_id"] == "a"
    assert rows["a"]["n_descendants"] == 3 and rows["c"]["n_descendants"] == 0
    assert rows["x"]["root_id"] == "cycle" and rows["x"]["path"] is None
