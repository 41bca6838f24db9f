"""Layouts in seed order against a serial scan over the seeds."""

import random

from helixframe.operators import grow

NODES = "node bigint, len bigint, cluster bigint, repeat boolean"
EDGES = "id1 bigint, id2 bigint, gap bigint"


def sign(x):
    return 1 if x > 0 else -1


def serial(nodes, edges, tolerance):
    """One seed after the other, one candidate after the other."""
    info = {n: (length, cluster or 0, bool(repeat)) for n, length, cluster, repeat in nodes}
    views = {}
    for x, y, gap in edges:
        if gap is None or abs(x) == abs(y) or abs(x) not in info or abs(y) not in info:
            continue
        for u, v in ((x, y), (-y, -x)):
            views.setdefault(abs(u), set()).add((sign(u), v, gap))
    owned, out = set(), []

    def nexts(part, steps):
        node, strand, start, end = part
        for side, v, gap in views.get(node, ()):
            turn = side * strand
            length = info[abs(v)][0]
            at = end + gap if turn > 0 else start - gap - length
            yield (steps + 1, abs(at), abs(v), sign(v) * turn, at, at + length)

    for seed in sorted(info):
        if info[seed][2] or seed in owned:
            continue
        lay, cluster = [(seed, 1, 0, info[seed][0])], info[seed][1]
        owned.add(seed)
        queue = set(nexts(lay[0], 0))
        while queue:
            c = min(queue)
            queue.remove(c)
            steps, _, node, strand, start, end = c
            _, own, repeat = info[node]
            if node in owned or (own and cluster and own != cluster) or (node, strand, start, end) in lay:
                continue
            if any(start < e and end > s and abs(start - e) > tolerance and abs(end - s) > tolerance for _, _, s, e in lay):
                continue
            lay.append((node, strand, start, end))
            cluster = cluster or own
            if not repeat:
                owned.add(node)
                queue |= set(nexts(lay[-1], steps))
        lay.sort(key=lambda p: (p[2], p[3], p[0], p[1]))
        while info[lay[0][0]][2]:
            lay.pop(0)
        while info[lay[-1][0]][2]:
            lay.pop()
        out += [(seed, n * s, a - lay[0][2], e - lay[0][2]) for n, s, a, e in lay]
    inside = {abs(r[1]) for r in out}
    return sorted(out + [(n, n, 0, i[0]) for n, i in info.items() if i[2] and n not in inside])


def grown(spark, nodes, edges, tolerance):
    lay = grow.layouts_in_seed_order(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), tolerance)
    return sorted(tuple(r) for r in lay.select("scaffold", "node", "start", "end").collect())


def random_graph(rng, first, n, m):
    """A few alike lengths and gaps make ties, repeats, clusters and collisions common."""
    nodes = [(first + i, rng.choice((30, 60, 61, 120)), rng.choice((0, 0, 0, 1, 2, None)), rng.random() < 0.2) for i in range(n)]
    edges = []
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        edges.append(((first + a) * rng.choice((1, -1)), (first + b) * rng.choice((1, -1)), rng.choice((-15, 0, 5, 40, 150))))
    return nodes, edges + edges[:2]


def test_equals_a_serial_scan(spark):
    """Twenty graphs side by side in one table."""
    rng = random.Random(3)
    nodes, edges = [], []
    for g in range(20):
        size = rng.randrange(2, 7)
        a, b = random_graph(rng, 100 * g + 1, size, rng.randrange(1, 2 * size))
        nodes += a
        edges += b
    want = serial(nodes, edges, 10)
    assert len({r[0] for r in want}) < len(nodes)       # something grows
    assert grown(spark, nodes, edges, 10) == want


def test_a_long_chain_and_a_repeat_in_two_layouts(spark):
    chain = [(i, 50, 0, False) for i in range(1, 8)]
    links = [(i, i + 1, 10) for i in range(1, 7)]
    # the repeat 40 stands inside the layouts of 30 and of 50, and at the end of 60
    more = [(30, 50, 1, False), (31, 50, 1, False), (40, 20, 0, True), (41, 20, 0, True), (50, 50, 2, False), (51, 50, 2, False), (60, 50, 3, False)]
    links += [(30, 40, 5), (30, 31, 40), (50, -40, 5), (50, 51, 40), (60, 40, 5), (60, 41, 300)]
    got = grown(spark, chain + more, links, 10)
    assert got == serial(chain + more, links, 10)
    assert sum(abs(r[1]) == 40 for r in got) == 2 and (41, 41, 0, 20) in got
    assert [r[1] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[2])] == list(range(1, 8))


def test_cases(spark):
    assert grown(spark, [], [], 5) == []
    assert grown(spark, [(3, 10, None, None)], [(3, 4, 0), (3, 3, 0), (None, 3, 1)], 5) == [(3, 3, 0, 10)]
    assert grown(spark, [(1, 10, 0, True)], [], 5) == [(1, 1, 0, 10)]
    assert grown(spark, [(1, 10, 0, False), (2, 10, 0, False)], [(1, 2, None)], 5) == [(1, 1, 0, 10), (2, 2, 0, 10)]


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 41)], "node bigint")
    pairs = [(i, i + 1) for i in range(1, 20)] + [(40, 30), (35, 30), (35, 33)]
    got = dict(tuple(r) for r in grow.components(nodes, spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    want = {i: 1 if i <= 20 else 30 if i in (30, 33, 35, 40) else i for i in range(1, 41)}
    assert got == want


def test_no_step_passes_through_the_driver(spark, monkeypatch):
    """Every step table comes from joins that deal both sides by key."""
    plans, write = [], grow.materialize

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(grow, "materialize", seen)
    nodes, links = [(i, 50, i % 2, i == 4) for i in range(1, 6)], [(1, 2, 10), (2, 3, 10), (3, 4, 5)]
    assert grown(spark, nodes, links, 10) == serial(nodes, links, 10)
    assert any("Join" in p for _, p in plans) and [label for label, p in plans if "Broadcast" in p] == []
