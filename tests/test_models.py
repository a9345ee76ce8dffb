"""Models against NumPy."""

import numpy as np

from kinfold.operators import hierarchy as H
from kinfold.operators import models as L
from kinfold.operators import pedigree as K


def table(spark, seed=0, n=60):
    rng = np.random.default_rng(seed)
    rows = [(int(k), "ABC"[k % 3], float(rng.normal(k % 3, 1)), float(rng.normal(2 - k % 3, 0.7))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "i int, c string, x double, y double")


def lda(rows, at):
    cs = sorted({r[1] for r in rows})
    x = {c: np.array([r[2:] for r in rows if r[1] == c]) for c in cs}
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values()) / (len(rows) - len(cs))
    inv = np.linalg.inv(pooled)
    s = np.array([at @ inv @ x[c].mean(0) - x[c].mean(0) @ inv @ x[c].mean(0) / 2 + np.log(len(x[c]) / len(rows)) for c in cs])
    e = np.exp(s - s.max())
    return dict(zip(cs, e / e.sum()))


def test_discriminant_and_leave_one_out(spark):
    rows, df = table(spark)
    model = L.lda_fit(df, "c", ("x", "y"))
    got = {(r.i, r["class"]): r.p for r in L.lda_score(df, model, ("x", "y")).collect()}
    left = {(r.i, r["class"]): r.p for r in L.lda_leave_one_out(df, "c", ("x", "y")).collect()}
    best = {r.i: r.predicted for r in L.lda_predict(df, model, ("x", "y")).collect()}
    for row in rows:
        want, without = lda(rows, np.array(row[2:])), lda([r for r in rows if r is not row], np.array(row[2:]))
        assert best[row[0]] == max(want, key=want.get)
        for c in "ABC":
            assert abs(got[row[0], c] - want[c]) < 1e-9
            assert abs(left[row[0], c] - without[c]) < 1e-9


def test_mixture_finds_two_groups(spark):
    rng = np.random.default_rng(1)
    points = [(float(a), float(b)) for a, b in np.concatenate([rng.normal((0.5, 0), 0.03, (200, 2)), rng.normal((0.5, 0.25), 0.03, (100, 2))])]
    df = spark.createDataFrame(points, "x double, y double")
    for kind in ("spherical", "tied"):
        model = L.gmm_fit(df, ("x", "y"), [[0.5, 0.05], [0.5, 0.2]], covariance=kind)
        assert np.allclose(model.means, [[0.5, 0], [0.5, 0.25]], atol=0.01) and abs(model.weights[0] - 2 / 3) < 0.02
        assert L.gmm_score(df, model, ("x", "y")).where("component = 1").count() in range(98, 103)


def test_mixture_equals_its_rounds(spark):
    """EM by hand: responsibilities of the nearest mean first, then rounds until the mean log-likelihood moves less than the tolerance."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal((0.5, 0), 0.08, (60, 2)), rng.normal((0.5, 0.25), 0.08, (40, 2))])
    means = np.array([[0.5, 0.0], [0.5, 0.25]])
    r = np.eye(2)[((x[:, None] - means) ** 2).sum(2).argmin(1)]
    mu, before, n = None, -np.inf, 0
    while True:
        mass = r.sum(0)
        centre = r.T @ x / mass[:, None]
        var = np.array([(r[:, k, None] * (x - centre[k]) ** 2).sum() / mass[k] / 2 for k in (0, 1)]) + 1e-6
        mu = means if mu is None else centre
        logs = np.log(mass / mass.sum()) - np.log(2 * np.pi * var) - ((x[:, None] - mu) ** 2).sum(2) / (2 * var)
        if n and abs(now - before) < 1e-3:
            break
        before, now = (now if n else -np.inf), np.logaddexp(*logs.T).mean()
        r = np.exp(logs - np.logaddexp(*logs.T)[:, None])
        n += 1
    model = L.gmm_fit(spark.createDataFrame(x.tolist(), "x double, y double"), ("x", "y"), means)
    assert model.rounds == n and np.allclose(model.means, centre, atol=1e-9) and np.allclose(model.weights, mass / mass.sum(), atol=1e-9) and np.allclose(model.covs[:, 0, 0], var, atol=1e-9)


def test_cascade_example(spark):
    probs = spark.createDataFrame([(1, 2, "2nd", 0.8), (1, 2, "3rd", 0.2), (1, 2, "HS", 0.3), (1, 2, "GPAV", 0.1)], "id1 long, id2 long, node string, p_con double")
    tree = H.tree_table(spark)
    got = {r.node: round(r.p, 9) for r in H.cascade(probs, tree).collect()}
    assert got == {"2nd": 0.8, "3rd": 0.2, "HS": 0.6, "GPAV": 0.2}
    row = H.most_probable(H.cascade(probs, tree), tree, 0.5).first()
    assert (row.most_probable, round(row.probability, 9), row.degree) == ("HS", 0.6, "2nd")


def test_cascade_of_a_deep_tree(spark):
    names = [f"n{k}" for k in range(7)]
    tree = H.tree_table(spark, tuple(zip(names, (H.ROOT, *names))))
    probs = spark.createDataFrame([(1, 2, n, 0.5) for n in names] + [(1, 2, "side", 0.5)], "id1 long, id2 long, node string, p_con double")
    both = H.tree_table(spark, (*zip(names, (H.ROOT, *names)), ("side", "n5")))
    assert {r.p for r in H.cascade(probs.where("node <> 'side'"), tree).collect()} == {1.0}
    assert {r.node: r.p for r in H.cascade(probs, both).collect()}["n6"] == 0.5


def test_no_node_over_the_limit_gives_the_degree(spark):
    probs = spark.createDataFrame([(1, 2, "2nd", 0.5), (1, 2, "3rd", 0.5)], "id1 long, id2 long, node string, p_con double")
    tree = H.tree_table(spark)
    assert H.most_probable(H.cascade(probs, tree), tree, 0.5).first().most_probable == "2nd"


def codes_of(spark, ways):
    """Name and expected sharing of one pair with the paths given by parent sex."""
    rows, sexes = [], [(100, 1), (200, 2)]
    for n, (sex, dirs) in enumerate(ways):
        rows.append((1, 2, 100 * sex, [1, 100 * sex, *range(1000 + 10 * n, 1000 + 10 * n + len(dirs) - 1)], dirs, False))
    paths = spark.createDataFrame(rows, "focal long, id2 long, first_parent long, ids array<long>, dirs array<int>, open boolean")
    groups = K.path_groups(paths, spark.createDataFrame(sexes, "iid long, sex int"))
    name = K.name_relationships(groups, K.codes_table(spark)).first().name
    kin = K.expected_kinship(groups).first()
    return name, kin.ibd1, kin.ibd2


def test_code_lookup(spark):
    assert codes_of(spark, [(1, [1, 1, -1]), (1, [1, 1, -1])]) == ("AV", 0.5, 0.0)
    assert codes_of(spark, [(1, [1, 1, -1, -1]), (2, [1, 1, -1, -1])])[0] == "CO"
    assert codes_of(spark, [(1, [1, 1, -1, -1]), (1, [1, 1, -1, -1]), (2, [1, 1, -1, -1])]) == ("COHCO", 0.3125, 0.03125)
    assert codes_of(spark, [(2, [1, 1])])[0] == "MGP"


def test_loop_in_the_pedigree_ends(spark):
    po = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "parent long, child long")
    got = {(r.focal, r.id2, tuple(r.dirs)) for r in K.pedigree_paths(po).collect()}
    assert (3, 1, (1, 1)) in got and (3, 1, (1,)) in got and all(f != t for f, t, _ in got)


def test_mixture_starts_from_clusters(spark):
    """The start is that of k-means, not of the nearest given mean; both differ here, and so do the fits."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal((0.5, 0.16), 0.03, (60, 2)), rng.normal((0.5, 0.3), 0.05, (50, 2))])
    means = np.array([(0.5, 0.0), (0.5, 0.25)])
    nearest = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)

    def em(at, rounds):
        r = np.eye(2)[at]
        for n in range(rounds + 1):
            if n:
                logs = np.log(w) - np.log(2 * np.pi * v) - ((x[:, None] - m[None]) ** 2).sum(2) / (2 * v)
                r = np.exp(logs - logs.max(1, keepdims=True))
                r /= r.sum(1, keepdims=True)
            mass = r.sum(0)
            w, own = mass / len(x), r.T @ x / mass[:, None]
            v = ((r[:, :, None] * x[:, None] ** 2).sum(0) / mass[:, None] - own**2).sum(1) / 2 + 1e-6
            m = own if n else means
        return w, m, v

    centre = means.copy()
    for _ in range(100):
        at = nearest(centre)
        centre = np.array([x[at == k].mean(0) if (at == k).any() else centre[k] for k in range(2)])
    assert (nearest(means) != nearest(centre)).sum() > 20
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double")
    assert np.allclose(L.kmeans(df, means), centre, atol=1e-9)
    got = L.gmm_fit(df, ("x", "y"), means, rounds=2, tol=0.0)
    w, m, v = em(nearest(centre), 2)
    assert np.allclose(got.weights, w) and np.allclose(got.means, m) and np.allclose(got.covs[:, 0, 0], v)
    assert not np.allclose(em(nearest(means), 2)[1], m, atol=1e-3)
