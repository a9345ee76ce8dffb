"""Discriminant and mixture models fitted by aggregates and scored by expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lda_fit(df: DataFrame, label: str, features: tuple[str, str]) -> DataFrame:
    """``class, n, prior, m1, m2, i11, i12, i22``: class frequencies and means, inverse pooled covariance over n - K.

    Rows with a null or NaN feature or a null label are left out.  Fewer than K + 1 rows or collinear features raise an error when scored.
    """
    x, y = features
    rows = df.where(f"`{label}` is not null and `{x}` is not null and `{y}` is not null and not isnan(`{x}`) and not isnan(`{y}`)")
    per = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), *[(F.covar_pop(a, b) * F.count(F.lit(1))).alias(c) for a, b, c in ((x, x, "s11"), (x, y, "s12"), (y, y, "s22"))])
    all_ = per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"t{c[1:]}") for c in ("s11", "s12", "s22")])  # one row
    both = per.withColumn("one", F.lit(1)).join(F.broadcast(all_.withColumn("one", F.lit(1))), "one")
    free = F.col("total") - F.col("k")
    det = F.col("t11") * F.col("t22") - F.col("t12") * F.col("t12")
    return both.select("class", "n", "total", "k", "s11", "s12", "s22", "t11", "t12", "t22", (F.col("n") / F.col("total")).alias("prior"), "m1", "m2", (free * F.col("t22") / det).alias("i11"), (-free * F.col("t12") / det).alias("i12"), (free * F.col("t11") / det).alias("i22"))


def _packed(model: DataFrame) -> DataFrame:
    """All classes in one row, so scoring needs no product of tables."""
    return F.broadcast(model.agg(F.sort_array(F.collect_list(F.struct(*model.columns))).alias("classes")).withColumn("one", F.lit(1)))  # one row of few classes


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _softmax(scores: Column) -> Column:
    """``class, p`` from ``class, score``; the largest score and the sum are each worked out once a row."""
    raised = lambda s, top: F.transform(s, lambda x: F.struct(x["class"].alias("class"), F.exp(x["score"] - top).alias("e")))
    shares = lambda r, total: F.transform(r, lambda x: F.struct(x["class"].alias("class"), (x["e"] / total).alias("p")))
    summed = lambda r: _once(F.aggregate(r, F.lit(0.0), lambda a, x: a + x["e"]), lambda total: shares(r, total))
    return _once(scores, lambda s: _once(F.array_max(F.transform(s, lambda x: x["score"])), lambda top: _once(raised(s, top), summed)))


def lda_score(df: DataFrame, model: DataFrame, features: tuple[str, str]) -> DataFrame:
    """Rows of ``df`` with ``class, p``, one for each class."""
    x, y = (F.col(f).cast("double") for f in features)

    def score(c: Column) -> Column:
        a, b = c["i11"] * c["m1"] + c["i12"] * c["m2"], c["i12"] * c["m1"] + c["i22"] * c["m2"]
        return F.struct(c["class"].alias("class"), (a * x + b * y - (a * c["m1"] + b * c["m2"]) / 2 + F.log(c["prior"])).alias("score"))

    both = df.withColumn("one", F.lit(1)).join(_packed(model.select("class", "prior", "m1", "m2", "i11", "i12", "i22")), "one").drop("one")
    scored = both.withColumn("scores", F.transform("classes", score)).withColumn("probs", _softmax(F.col("scores")))
    return scored.select(*df.columns, F.inline("probs"))


def lda_predict(df: DataFrame, model: DataFrame, features: tuple[str, str], name: str = "predicted") -> DataFrame:
    """Rows of ``df`` with the likeliest class, the first by name on ties."""
    x, y = (F.col(f).cast("double") for f in features)

    def score(c: Column) -> Column:
        a, b = c["i11"] * c["m1"] + c["i12"] * c["m2"], c["i12"] * c["m1"] + c["i22"] * c["m2"]
        return F.struct((-(a * x + b * y - (a * c["m1"] + b * c["m2"]) / 2 + F.log(c["prior"]))).alias("s"), c["class"].alias("class"))

    both = df.withColumn("one", F.lit(1)).join(_packed(model.select("class", "prior", "m1", "m2", "i11", "i12", "i22")), "one").drop("one")
    return both.withColumn(name, F.array_min(F.transform("classes", score))["class"]).drop("classes")


def lda_leave_one_out(df: DataFrame, label: str, features: tuple[str, str]) -> DataFrame:
    """M5: each row's class probabilities by a model without that row, in closed form.

    Taking x out of its class moves the mean by (m - x) / (n - 1) and lessens the scatter by n / (n - 1) d d'.
    Rows whose class has no other row are left out.
    """
    x, y = features
    model = lda_fit(df, label, features)
    rows = df.where(f"`{label}` is not null and `{x}` is not null and `{y}` is not null and not isnan(`{x}`) and not isnan(`{y}`)")
    own = model.select(F.col("class").alias("own"), F.col("n").alias("own_n"), F.col("m1").alias("own_m1"), F.col("m2").alias("own_m2"), "total", "k", "t11", "t12", "t22")
    out = rows.join(F.broadcast(own), rows[label] == own["own"]).where("own_n > 1")  # few classes
    d1, d2, f = F.col(x) - F.col("own_m1"), F.col(y) - F.col("own_m2"), F.col("own_n") / (F.col("own_n") - 1)
    out = out.withColumns({"l11": F.col("t11") - f * d1 * d1, "l12": F.col("t12") - f * d1 * d2, "l22": F.col("t22") - f * d2 * d2, "free": F.col("total") - 1 - F.col("k"), "rest": F.col("total") - 1})
    out = out.withColumn("det", F.col("l11") * F.col("l22") - F.col("l12") * F.col("l12"))
    out = out.withColumn("one", F.lit(1)).join(_packed(model.select("class", "n", "m1", "m2")), "one")

    def score(c: Column) -> Column:
        mine = c["class"] == F.col("own")
        n = c["n"] - mine.cast("int")
        m1 = F.when(mine, c["m1"] - d1 / (c["n"] - 1)).otherwise(c["m1"])
        m2 = F.when(mine, c["m2"] - d2 / (c["n"] - 1)).otherwise(c["m2"])
        a = F.col("free") * (F.col("l22") * m1 - F.col("l12") * m2) / F.col("det")
        b = F.col("free") * (F.col("l11") * m2 - F.col("l12") * m1) / F.col("det")
        return F.struct(c["class"].alias("class"), (a * F.col(x) + b * F.col(y) - (a * m1 + b * m2) / 2 + F.log(n / F.col("rest"))).alias("score"))

    out = out.withColumn("scores", F.transform("classes", score)).withColumn("probs", _softmax(F.col("scores")))
    return out.select(*df.columns, F.inline("probs"))


def nsegs_curve(model: DataFrame, n_from: int, n_to: int, k: float) -> DataFrame:
    """Class probabilities for every segment count at one kinship, with GP and HS as sums of their parts."""
    grid = model.sparkSession.range(n_from, n_to).select(F.col("id").alias("n"), F.lit(k).alias("k"))
    long = lda_score(grid, model, ("n", "k")).select("n", "class", "p")
    part = lambda *names: F.sum(F.when(F.col("class").isin(*names), F.col("p")).otherwise(0.0))
    sums = long.groupBy("n").agg(part("PGP", "MGP").alias("GP"), part("PHS", "MHS").alias("HS")).unpivot("n", ["GP", "HS"], "class", "p")
    return long.unionByName(sums)


class Mixture:
    """Parameters of a Gaussian mixture in two features."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, rounds: int):
        self.weights, self.means, self.covs, self.rounds = weights, means, covs, rounds

    def _logs(self, features: tuple[str, str]) -> list[Column]:
        """Log of each component's weight times density, as columns."""
        x, y = (F.col(f).cast("double") for f in features)
        logs = []
        for w, m, c in zip(self.weights, self.means, self.covs, strict=True):
            inv, det = np.linalg.inv(c), float(np.linalg.det(c))
            a, b = x - float(m[0]), y - float(m[1])
            logs.append(F.lit(float(np.log(w) - 0.5 * np.log(det) - np.log(2 * np.pi))) - 0.5 * (float(inv[0, 0]) * a * a + float(2 * inv[0, 1]) * a * b + float(inv[1, 1]) * b * b))
        return logs

    def log_likelihood(self, features: tuple[str, str]) -> Column:
        logs = self._logs(features)
        top = F.greatest(*logs)
        raised = [F.exp(v - top) for v in logs]
        return top + F.log(sum(raised[1:], raised[0]))

    def responsibilities(self, features: tuple[str, str]) -> list[Column]:
        """Each component's probability, as columns."""
        logs = self._logs(features)
        top = F.greatest(*logs)
        raised = [F.exp(v - top) for v in logs]
        total = sum(raised[1:], raised[0])
        return [r / total for r in raised]


def kmeans(rows: DataFrame, means: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Centres of the rows (x, y) by Lloyd's rounds from given means, each one aggregate, until no centre moves by more than ``tol``; an empty cluster stays where it is."""
    centre = np.array(means, float)
    for _ in range(rounds):
        near = _nearest(centre)
        cols = [f(F.when(near == k + 1, F.col(c))).alias(f"{c}{k}") for k in range(len(centre)) for c, f in (("x", F.avg), ("y", F.avg))]
        found = rows.agg(*cols).first()
        moved = np.array([old if new is None else new for new, old in zip(found, centre.ravel(), strict=True)], float).reshape(centre.shape)
        step, centre = np.abs(moved - centre).max(), moved
        if step <= tol:
            break
    return centre


def _nearest(centre: np.ndarray) -> Column:
    """The number of the nearest centre from 1, the first on ties."""
    far = F.array(*((F.col("x") - float(m[0])) ** 2 + (F.col("y") - float(m[1])) ** 2 for m in centre))
    return F.array_position(far, F.array_min(far))


def gmm_fit(df: DataFrame, features: tuple[str, str], means, weights=None, covariance: str = "spherical", rounds: int = 100, tol: float = 1e-3, floor: float = 1e-6) -> Mixture:
    """EM from given means; each round is one aggregate over the table.

    Weights (unless given) and covariances start from the clusters that k-means finds from the given means, the means themselves as given.  Ends when the mean log-likelihood moves less than ``tol``.
    """
    x, y = features
    rows = df.where(f"`{x}` is not null and `{y}` is not null and not isnan(`{x}`) and not isnan(`{y}`)").select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows, k = rows.persist(), len(means)

    def fitted(shares: list[Column], extra: Column, turn: int) -> tuple[Mixture, float]:
        """The mixture by the rows' shares in its components, and the mean of a column."""
        cols = []
        for c in shares:
            cols += [F.sum(c), F.sum(c * F.col("x")), F.sum(c * F.col("y")), F.sum(c * F.col("x") * F.col("x")), F.sum(c * F.col("x") * F.col("y")), F.sum(c * F.col("y") * F.col("y"))]
        found = rows.agg(*[c.alias(f"c{j}") for j, c in enumerate(cols)], F.avg(extra).alias("extra")).first()
        if found[0] is None:
            raise ValueError("no rows to fit a mixture on")
        got = np.array(found[:-1], float).reshape(k, 6)
        mass = np.maximum(got[:, 0], 1e-12)
        centre = got[:, 1:3] / mass[:, None]
        scatter = np.stack([np.array([[g[3], g[4]], [g[4], g[5]]]) / m - np.outer(mu, mu) for g, m, mu in zip(got, mass, centre, strict=True)])
        if covariance == "spherical":
            covs = np.stack([np.eye(2) * (np.trace(s) / 2 + floor) for s in scatter])
        else:
            covs = np.stack([np.einsum("k,kij->ij", mass, scatter) / mass.sum() + np.eye(2) * floor] * k)
        return Mixture(mass / mass.sum(), centre, covs, turn), float(found["extra"])

    try:
        nearest = _nearest(kmeans(rows, means)) if k > 1 else F.lit(1)
        model, _ = fitted([(nearest == n + 1).cast("double") for n in range(k)], F.lit(0.0), 0)
        model.means = np.array(means, float)
        if weights is not None:
            model.weights = np.array(weights, float)
        before = -np.inf
        for turn in range(1, rounds + 1):
            model, now = fitted(model.responsibilities(("x", "y")), model.log_likelihood(("x", "y")), turn)
            if abs(now - before) < tol:
                break
            before = now
        return model
    finally:
        rows.unpersist()


def gmm_score(df: DataFrame, model: Mixture, features: tuple[str, str]) -> DataFrame:
    """Rows with ``component`` (from 0) and its probability; the first on ties."""
    r = model.responsibilities(features)
    every = F.array(*r)
    return df.withColumns({"probability": F.array_max(every), "component": (F.array_position(every, F.array_max(every)) - 1).cast("int")})
