import random

from termloom.llm import components


def groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in parent}


def run(table, edges, **kw):
    rows = components.connected_components(table("u int, v int", edges), **kw).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_paths_stars_cycles_and_random_graphs(table):
    rng = random.Random(3)
    path = list(range(1, 120))
    rng.shuffle(path)
    edges = (
        list(zip(path, path[1:]))
        + [(1000, 1000 + i) for i in range(1, 80)]
        + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    )
    assert run(table, edges) == groups(edges)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)]
    assert run(table, edges, cell_edges=10) == groups(edges)  # many cells
    hub = [(5, i) for i in range(6, 400)] + [(i, i + 1000) for i in range(300, 420)]
    assert run(table, hub, cell_edges=15) == groups(hub)  # the hub's cells are cut into parts


def test_nulls_loops_repeats_and_nothing(table):
    edges = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (7, -2)]
    assert run(table, edges) == {(1, 1), (1, 2), (-2, -2), (-2, 7)}
    assert run(table, []) == set()
    assert run(table, [(3, 3), (None, None)]) == set()


def test_only_the_stratum_ties_whatever_its_spelling(table):
    x = table(
        "source int, target int, stratum string, u int, v int",
        [(1, 2, " S1", 9, 9), (2, 3, "s1\t", 9, 9), (3, 4, "s2", 9, 9), (5, 6, None, 9, 9)]
    )
    assert {tuple(r) for r in components.tied_sequences(x).collect()} == {(1, 1), (1, 2), (1, 3)}
