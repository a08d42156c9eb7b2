"""Density clustering against a plain version: Kruskal over all pairs, the tree condensed from its root down."""

import numpy as np
import pytest

from lodestone.operators import density

TINY = density.CLOSEST


def distances(v, samples):
    v = np.array(v, dtype=float)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    d = np.maximum(np.round(1 - np.round(u @ u.T, 6), 6), 0)
    others = [np.sort(np.delete(row, i)) for i, row in enumerate(d)]
    core = np.array([o[min(samples, len(o)) - 1] for o in others])
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def plain_tree(w):
    n, edges, up = len(w), [], list(range(len(w)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if (a := root(i)) != (b := root(j)):
            up[b] = a
            edges.append((i, j, x))
    return edges


def plain_topics(ids, v, least, samples):
    w = distances(v, samples)
    nodes, at = {}, {i: i for i in range(len(ids))}  # node -> (left, right, length, points)
    points = {i: [i] for i in range(len(ids))}
    for k, (i, j, x) in enumerate(plain_tree(w)):
        a, b = at[i], at[j]
        name = len(ids) + k
        nodes[name] = (a, b, x)
        points[name] = points[a] + points[b]
        for p in points[name]:
            at[p] = name
    stable, chosen, near = {}, {}, {}

    def condense(node, birth, root):
        """Stability and choice of the cluster that begins at ``node``: ({cluster: points}, stability)."""
        mass, inner, todo, held = 0.0, [], [node], points[node]
        while todo:
            x = todo.pop()
            if x not in nodes:
                continue
            a, b, length = nodes[x]
            rate = 1 / max(length, TINY)
            big = [c for c in (a, b) if len(points[c]) >= least]
            for c in (a, b):
                if c not in big:
                    for p in points[c]:
                        mass += rate - birth
                        near[p] = rate
            if len(big) == 2:
                mass += (len(points[a]) + len(points[b])) * (rate - birth)
                inner = [condense(c, rate, False) for c in big]
            else:
                todo += big
        best = sum(s for _, s in inner)
        if not root and (not inner or round(mass, 6) >= round(best, 6)):
            return [held], mass
        return [c for found, _ in inner for c in found], best

    top = len(ids) + len(nodes) - 1
    found = condense(top, 0.0, True)[0] if nodes and len(ids) >= least else []
    found.sort(key=lambda c: (-len(c), min(ids[p] for p in c)))
    out = {i: (-1, 0.0) for i in ids}
    for topic, members in enumerate(found):
        most = max(near[p] for p in members)
        for p in members:
            out[ids[p]] = (topic, round(near[p] / most, 6))
    return out


def clouds(seed, n, centres, dims=6, noise=0.3, width=0.08):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = [middle[rng.integers(centres)] + width * rng.normal(size=dims) if rng.random() > noise else rng.normal(size=dims) for _ in range(n)]
    rows[3], rows[5], rows[7] = rows[2], rows[2], rows[6]  # points on one place
    return [[round(float(x), 3) for x in r] for r in rows]


@pytest.mark.parametrize("seed,n,centres,least,samples,more,chunk", [(1, 90, 4, 5, 3, 2, 1_000_000), (2, 120, 6, 6, 4, 1, 25), (3, 60, 1, 8, 5, 10, 17)])
def test_topics_match_the_plain_version(spark, seed, n, centres, least, samples, more, chunk):
    v = clouds(seed, n, centres)
    ids = [int(x) for x in np.random.default_rng(seed).permutation(10 * n)[:n]]
    order = np.argsort(ids)
    ids, v = [ids[i] for i in order], [v[i] for i in order]
    df = spark.createDataFrame([*zip(ids, v), (-5, None)], "id long, v array<double>")
    edges, _ = density.spanning_tree(df, samples, more)
    want = sorted((ids[i], ids[j], round(float(x), 6)) for i, j, x in plain_tree(distances(v, samples)))
    assert sorted((r.lo, r.hi, round(r.w, 6)) for r in edges.collect()) == want
    got = {r.id: (r.topic, r.topic_probability) for r in density.density_topics(df, least, samples, more, chunk).collect()}
    plain = plain_topics(ids, v, least, samples)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in plain.items()}
    assert all(abs(got[i][1] - p) < 2e-6 for i, (_, p) in plain.items())
    assert centres == 1 or (len({t for t, _ in got.values()}) > 2 and any(t == -1 for t, _ in got.values()))


def test_few_points(spark):
    for rows in ([], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]):
        got = density.density_topics(spark.createDataFrame(rows, "id long, v array<double>"), 2, 1).collect()
        assert len(got) == len(rows) and all(r.topic == -1 for r in got)


def test_blocks_meet_where_they_lie(spark):
    """No vector is copied or shuffled a block of the other side."""
    from lodestone.operators.retrieval import blocks, met

    points = spark.range(50).selectExpr("id", "array(double(id), 1.0) AS v", "id % 3 AS _k_l")
    left, right = blocks(points, "id", 4, "_k_l"), blocks(points.selectExpr("id AS id2", "v AS w", "_k_l AS _k_r"), "id2", 9, "_k_r")
    pairs = met(left, right, "_k")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    rows = pairs.selectExpr("explode(arrays_zip(id)) AS a", "id2").selectExpr("a.id", "explode(id2) AS id2")
    assert rows.distinct().count() == rows.count() == 17 * 17 + 17 * 17 + 16 * 16
