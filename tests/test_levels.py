"""Cycles and levels of dependency graphs, against a plain model."""

import random

from trellis.operators import cycles, dependency_levels


def model(edges):
    """{node: (level, cycle)} by plain reachability."""
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    while True:
        more = {n: reach[n] | {x for m in reach[n] for x in reach[m]} for n in nodes}
        if more == reach:
            break
        reach = more
    ring = {n: min(m for m in nodes if n in reach[m] and m in reach[n]) if n in reach[n] else None for n in nodes}
    group = {n: n if ring[n] is None else ring[n] for n in nodes}

    def level(g):
        below = {group[b] for a, b in edges if group[a] == g} - {g}
        return 1 + max(map(level, below)) if below else 0

    return {n: (level(group[n]), ring[n]) for n in nodes}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_levels_equal_a_plain_model(spark):
    rng = random.Random(4)
    edges, base = [], 0
    for n, m in ((12, 14), (9, 7), (6, 12)):  # graphs side by side: with one large cycle, with few, with several
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(m)]
        base += 100
    # two cycles in a row, with a tail before, between and after
    edges += [(900, 901), (901, 902), (902, 901), (902, 903), (903, 904), (904, 905), (905, 904), (905, 906)]
    want = model(set(edges))
    df = frame(spark, edges + edges[:5] + [(None, 1), (900, None)])
    assert {r.node: (r.level, r.cycle) for r in dependency_levels(df).collect()} == want
    assert want[900] == (4, None) and want[901] == (3, 901) and want[904] == (1, 904)


def test_levels_of_nothing_and_of_loops(spark):
    assert dependency_levels(frame(spark, [])).count() == 0
    assert cycles(frame(spark, [(1, 1), (1, 2)])).collect() == [(1, 1)]
    assert sorted(dependency_levels(frame(spark, [(1, 1), (1, 2)])).collect()) == [(1, 1, 1), (2, 0, None)]
