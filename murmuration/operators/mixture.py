"""Bayesian mixture components as DataFrames: sufficient statistics, posterior predictives, marginals, MAP.

Three families: ``fixed`` (a known variance a dimension), ``diag`` (normal-inverse-chi-squared a dimension) and
``full`` (normal-inverse-Wishart). Fixed and diag are expressions; full needs matrix arithmetic and runs on the
driver over one row a component, or in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrowtools import matrix
from ..functions import arrays
from ..functions.special import lgamma
from ..session import write_table
from .neighbours import MAX_VALUES
from .segments import moments

LOG_PI, LOG_2PI = math.log(math.pi), math.log(2 * math.pi)


@dataclass
class FixedPrior:
    """Known variance ``var``; the mean is normal around ``mu_0`` with variance ``var_0`` (lists, one a dimension)."""

    var: list[float]
    mu_0: list[float]
    var_0: list[float]

    @property
    def dim(self) -> int:
        return len(self.var)


@dataclass
class ConjugatePrior:
    """``m_0, k_0, v_0, s_0`` of a normal-inverse-Wishart prior; ``s_0`` is a list for diag, a matrix for full."""

    m_0: list[float]
    k_0: float
    v_0: float
    s_0: list
    dim: int = field(init=False)

    def __post_init__(self) -> None:
        self.dim = len(self.m_0)
        if self.v_0 < self.dim:
            raise ValueError("v_0 must be at least the number of dimensions")


def fixed_prior(vectors: DataFrame, k_0: float = 0.05, s_0: float = 0.1) -> FixedPrior:
    """The prior from the data: mean 0, variance ``(population variance + 1e-6) * s_0``, and that over ``k_0``."""
    row = moments(vectors).first()
    var = [(v + 1e-6) * s_0 for v in row["var"]]
    return FixedPrior(var, [0.0] * len(var), [v / k_0 for v in var])


def component_stats(vectors: DataFrame, assignments: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """``k, n, s, ss``: count, sum and sum of squares a dimension of each component. ``assignments``: ``id_col, k``;
    a null or negative k is unassigned and gives no row."""
    rows = vectors.join(assignments.where("k >= 0").select(id_col, "k"), id_col)
    s = Summarizer.metrics("count", "sum").summary(array_to_vector(arrays.doubles(F.col("x")))).alias("s")
    q = Summarizer.sum(array_to_vector(F.transform(arrays.doubles(F.col("x")), lambda v: v * v))).alias("q")
    return rows.groupBy("k").agg(s, q).select("k", F.col("s.count").alias("n"), vector_to_array("s.sum").alias("s"), vector_to_array("q").alias("ss"))


def component_outer(vectors: DataFrame, assignments: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """``k, n, s, outer``: as ``component_stats``, with the sum of outer products, row by row in one array of D * D."""
    rows = vectors.join(assignments.where("k >= 0").select(id_col, "k"), id_col).select(F.col("k").cast("bigint").alias("k"), F.col("x").cast("array<double>").alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at, x = matrix(batch.column(1), int(np.diff(batch.column(1).offsets.to_numpy()).max()))
            k = batch.column(0).to_numpy()[at]
            for c in np.unique(k).tolist():
                own = x[k == c]
                new = [len(own), own.sum(0), own.T @ own]
                sums[c] = [a + b for a, b in zip(sums[c], new)] if c in sums else new
        keys = sorted(sums)
        rows = [[*sums[c][1].tolist(), *sums[c][2].ravel().tolist()] for c in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sums[c][0] for c in keys], pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["k", "n", "v"])

    total = rows.mapInArrow(add, "k bigint, n bigint, v array<double>").groupBy("k").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    d = F.floor((F.sqrt(F.lit(1.0) + 4 * F.size("v")) - 1) / 2 + 0.5).cast("int")
    return total.select("k", "n", F.slice("v", 1, d).alias("s"), F.slice("v", d + 1, d * d).alias("outer"))


def _lit(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _zip3(a: Column, b: Column, c: Column, f: object) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda z: f(z["a"], z["b"], z["c"]))


def log_marginal_fixed(stats: DataFrame, prior: FixedPrior) -> DataFrame:
    """``k, log_marg``: log marginal probability of the data of each component."""
    n = F.col("n").cast("double")
    zipped = F.arrays_zip(F.col("s").alias("s"), F.col("ss").alias("q"), _lit(prior.var).alias("v"), _lit(prior.mu_0).alias("m"), _lit(prior.var_0).alias("w"))

    def term(z: Column) -> Column:
        s, q, v, m, w = (z[c] for c in "sqvmw")
        spread = n * w + v
        fit = (s * s * w / v + m * m * v / w + 2 * s * m) / spread
        return -(n - 1) / 2 * F.log(v) - n / 2 * LOG_2PI - F.log(spread) / 2 - q / (2 * v) - m * m / (2 * w) + fit / 2

    return stats.select("k", _total(F.transform(zipped, term)).alias("log_marg"))


def log_marginal_diag(stats: DataFrame, prior: ConjugatePrior) -> DataFrame:
    """``k, log_marg`` of the diagonal family."""
    n, d = F.col("n").cast("double"), prior.dim
    k_n, v_n = n + prior.k_0, n + prior.v_0
    s_n = _zip3(F.col("s"), F.col("ss"), F.arrays_zip(_lit(prior.m_0).alias("m"), _lit(prior.s_0).alias("p")), lambda s, q, z: z["p"] + prior.k_0 * z["m"] * z["m"] + q - (s + prior.k_0 * z["m"]) * (s + prior.k_0 * z["m"]) / k_n)
    log_s0 = sum(math.log(v) for v in prior.s_0)
    value = -n * d / 2 * LOG_PI + d / 2 * math.log(prior.k_0) - F.log(k_n) * d / 2 + prior.v_0 / 2 * log_s0 - v_n / 2 * _total(F.transform(s_n, lambda v: F.log(v))) + (lgamma(v_n / 2) - math.lgamma(prior.v_0 / 2)) * d
    return stats.select("k", value.alias("log_marg"))


def predictive_parameters(stats: DataFrame, prior: FixedPrior | ConjugatePrior) -> DataFrame:
    """``k, n, mu, var, v``: mean, squared scale and degrees of freedom of each component's posterior predictive,
    for the fixed (v is null: a normal) and the diagonal family."""
    n = F.col("n").cast("double")
    if isinstance(prior, FixedPrior):
        zipped = F.arrays_zip(F.col("s").alias("s"), _lit(prior.var).alias("v"), _lit(prior.mu_0).alias("m"), _lit(prior.var_0).alias("w"))
        mu = F.transform(zipped, lambda z: (z["m"] / z["w"] + z["s"] / z["v"]) / (F.lit(1.0) / z["w"] + n / z["v"]))
        var = F.transform(zipped, lambda z: F.lit(1.0) / (F.lit(1.0) / z["w"] + n / z["v"]) + z["v"])
        return stats.select("k", "n", mu.alias("mu"), var.alias("var"), F.lit(None).cast("double").alias("v"))
    k_n, v_n = n + prior.k_0, n + prior.v_0
    zipped = F.arrays_zip(F.col("s").alias("s"), F.col("ss").alias("q"), _lit(prior.m_0).alias("m"), _lit(prior.s_0).alias("p"))
    mu = F.transform(zipped, lambda z: (z["s"] + prior.k_0 * z["m"]) / k_n)
    var = F.transform(zipped, lambda z: (k_n + 1) / (k_n * v_n) * (z["p"] + prior.k_0 * z["m"] * z["m"] + z["q"] - (z["s"] + prior.k_0 * z["m"]) * (z["s"] + prior.k_0 * z["m"]) / k_n))
    return stats.select("k", "n", mu.alias("mu"), var.alias("var"), v_n.alias("v"))


def predictive_arrays(params: DataFrame) -> tuple[np.ndarray, ...]:
    """The components of ``predictive_parameters`` in order of k, on the driver."""
    t = params.orderBy("k").toArrow()
    v = [math.nan if u is None else u for u in t["v"].to_pylist()]
    return t["k"].to_numpy(), t["n"].to_numpy(), np.array(t["mu"].to_pylist(), float), np.array(t["var"].to_pylist(), float), np.array(v, float)


def log_predictive(x: np.ndarray, mu: np.ndarray, var: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log density of each row under each component: a product of normals where v is NaN, else of Student t's."""
    out = np.zeros((len(x), len(mu)))
    for k in range(len(mu)):
        far = (x - mu[k]) ** 2 / var[k]
        if math.isnan(v[k]):
            out[:, k] = -0.5 * (len(mu[k]) * LOG_2PI + np.log(var[k]).sum() + far.sum(1))
        else:
            c = math.lgamma((v[k] + 1) / 2) - math.lgamma(v[k] / 2) - 0.5 * (math.log(v[k]) + LOG_PI)
            out[:, k] = len(mu[k]) * c - 0.5 * np.log(var[k]).sum() - (v[k] + 1) / 2 * np.log1p(far / v[k]).sum(1)
    return out


def score_predictive(vectors: DataFrame, stats: DataFrame, prior: FixedPrior | ConjugatePrior, id_col: str = "seg_id") -> DataFrame:
    """``id_col, k, log_pred``: the best component of each vector by posterior predictive (ties: the lowest k), and its
    log density. Components are sent to all tasks in blocks of ``MAX_VALUES`` numbers; more than one block takes a pass
    each and a maximum over the passes."""
    params = write_table(predictive_parameters(stats, prior), "predictive").df
    blocks = max(1, -(-params.count() * 2 * prior.dim // MAX_VALUES))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    out = None
    for b in range(blocks):
        shared = vectors.sparkSession.sparkContext.broadcast(predictive_arrays(params.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)))

        def score(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            ks, _, mu, var, v = shared.value
            for batch in batches:
                at, x = matrix(batch.column(1), mu.shape[1] if len(ks) else 0)
                if len(x) and len(ks):
                    p = log_predictive(x, mu, var, v)
                    best = p.argmax(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ks[best]), pa.array(p[np.arange(len(x)), best])], names=["id", "k", "log_pred"])

        found = rows.mapInArrow(score, "id bigint, k bigint, log_pred double")
        out = found if out is None else out.unionByName(found)
    return _best_of(out, blocks).withColumnRenamed("id", id_col)


def _best_of(scores: DataFrame, blocks: int) -> DataFrame:
    """The best of the ``blocks`` rows of each id."""
    if blocks == 1:
        return scores
    best = F.max(F.struct("log_pred", (-F.col("k")).alias("k"))).alias("m")
    return scores.groupBy("id").agg(best).select("id", (-F.col("m.k")).alias("k"), "m.log_pred")


def assignment_posteriors(vectors: DataFrame, stats: DataFrame, prior: FixedPrior | ConjugatePrior, alpha: float, k_max: int, id_col: str = "seg_id") -> DataFrame:
    """``id_col, k, prob``: for each vector and active component the probability of ``alpha / k_max + n`` times the
    posterior predictive, scaled to a sum of 1. Largest exponents are taken out first, so nothing underflows. There is a
    row for each vector and component; components of more than ``MAX_VALUES`` numbers are refused."""
    params = write_table(predictive_parameters(stats, prior), "predictive").df
    if params.count() * 2 * prior.dim > MAX_VALUES:
        raise ValueError(f"the components have more than {MAX_VALUES} numbers")
    shared = vectors.sparkSession.sparkContext.broadcast(predictive_arrays(params))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, n, mu, var, v = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), mu.shape[1])
            if len(x):
                p = log_predictive(x, mu, var, v) + np.log(alpha / k_max + n)
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                ids = batch.column(0).take(pa.array(np.repeat(at, len(ks))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(ks, len(x))), pa.array(p.ravel())], names=["id", "k", "prob"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    return rows.mapInArrow(score, "id bigint, k bigint, prob double").withColumnRenamed("id", id_col)


def log_prior_assignments(stats: DataFrame, alpha: float, k_max: int) -> DataFrame:
    """``log_prob_z``, one row: Dirichlet-multinomial probability of the counts, empty components up to ``k_max``
    included."""
    each = lgamma(F.col("n") + F.lit(alpha / k_max)) - math.lgamma(alpha / k_max)
    total = stats.agg(F.coalesce(F.sum(each), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return total.select((F.lit(math.lgamma(alpha)) - lgamma(F.col("n") + F.lit(float(alpha))) + F.col("s")).alias("log_prob_z"))


def full_posterior(n: int, s: np.ndarray, outer: np.ndarray, prior: ConjugatePrior) -> tuple[float, float, np.ndarray, np.ndarray]:
    """``k_N, v_N, m_N, S_N`` of a full-covariance component."""
    m_0, s_0 = np.array(prior.m_0), np.array(prior.s_0, float)
    k_n, v_n = prior.k_0 + n, prior.v_0 + n
    m_n = (prior.k_0 * m_0 + s) / k_n
    return k_n, v_n, m_n, s_0 + outer + prior.k_0 * np.outer(m_0, m_0) - k_n * np.outer(m_n, m_n)


def log_marginal_full(n: int, s: np.ndarray, outer: np.ndarray, prior: ConjugatePrior) -> float:
    """Log marginal probability of a full-covariance component."""
    d = prior.dim
    k_n, v_n, _, s_n = full_posterior(n, s, outer, prior)
    gammas = sum(math.lgamma((v_n + 1 - i) / 2) - math.lgamma((prior.v_0 + 1 - i) / 2) for i in range(1, d + 1))
    return -n * d / 2 * LOG_PI + d / 2 * (math.log(prior.k_0) - math.log(k_n)) + prior.v_0 / 2 * np.linalg.slogdet(np.array(prior.s_0, float))[1] - v_n / 2 * np.linalg.slogdet(s_n)[1] + gammas


def log_predictive_full(x: np.ndarray, n: int, s: np.ndarray, outer: np.ndarray, prior: ConjugatePrior) -> np.ndarray:
    """Log density of each row under a component's multivariate Student t; ``n = 0`` gives the prior's."""
    d = prior.dim
    k_n, v_n, m_n, s_n = full_posterior(n, s, outer, prior)
    v = v_n - d + 1
    cov = (k_n + 1) / (k_n * v) * s_n
    delta = x - m_n
    far = np.einsum("ij,ij->i", delta, np.linalg.solve(cov, delta.T).T)
    return math.lgamma((v + d) / 2) - math.lgamma(v / 2) - d / 2 * (math.log(v) + LOG_PI) - 0.5 * np.linalg.slogdet(cov)[1] - (v + d) / 2 * np.log1p(far / v)


def score_predictive_full(vectors: DataFrame, outer: DataFrame, prior: ConjugatePrior, id_col: str = "seg_id") -> DataFrame:
    """``id_col, k, log_pred``: the best full-covariance component of each vector by its multivariate Student t (ties: the
    lowest k). ``outer``: ``component_outer``. A component is D * D numbers; they are sent to all tasks in blocks of
    ``MAX_VALUES`` numbers, and more than one block takes a pass each and a maximum over the passes."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    outer = write_table(outer, "outer").df
    blocks = max(1, -(-outer.count() * prior.dim**2 // MAX_VALUES))
    out = None
    for b in range(blocks):
        t = outer.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).orderBy("k").toArrow()
        parts = [(k, n, np.array(s), np.array(o).reshape(prior.dim, prior.dim)) for k, n, s, o in zip(*(t[c].to_pylist() for c in ("k", "n", "s", "outer")))]
        shared = vectors.sparkSession.sparkContext.broadcast(parts)

        def score(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = matrix(batch.column(1), prior.dim)
                if len(x) and shared.value:
                    p = np.stack([log_predictive_full(x, n, s, o, prior) for _, n, s, o in shared.value], 1)
                    best = p.argmax(1)
                    ks = np.array([c[0] for c in shared.value], np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ks[best]), pa.array(p[np.arange(len(x)), best])], names=["id", "k", "log_pred"])

        found = rows.mapInArrow(score, "id bigint, k bigint, log_pred double")
        out = found if out is None else out.unionByName(found)
    return _best_of(out, blocks).withColumnRenamed("id", id_col)


def map_table(outer: DataFrame, prior: ConjugatePrior) -> DataFrame:
    """``k, n, mean, cov`` of ``component_outer``'s rows: the most probable mean and covariance (row by row) of each
    full component, as expressions."""
    d = prior.dim
    k_n, v_n = F.col("n") + prior.k_0, F.col("n") + prior.v_0
    mean = F.transform(F.arrays_zip(F.col("s").alias("s"), _lit(prior.m_0).alias("m")), lambda z: (z["s"] + prior.k_0 * z["m"]) / k_n)
    base = np.array(prior.s_0, float) + prior.k_0 * np.outer(prior.m_0, prior.m_0)
    table = outer.sparkSession.createDataFrame(pa.table({"base": pa.array([base.ravel().tolist()], pa.list_(pa.float64()))}))
    rows = outer.crossJoin(F.broadcast(table)).select("k", "n", mean.alias("mean"), F.zip_with("outer", "base", lambda a, b: a + b).alias("total"))
    cov = F.transform("total", lambda t, i: (t - k_n * F.get("mean", F.floor(i / d).cast("int")) * F.get("mean", (i % d).cast("int"))) / (v_n + d + 2))
    return rows.select("k", "n", "mean", cov.alias("cov"))


def marginals_full(outer: DataFrame, prior: ConjugatePrior) -> DataFrame:
    """``k, log_marg`` of ``component_outer``'s rows, full covariances; one matrix decomposition a component."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            out = [log_marginal_full(n, np.array(s), np.array(o).reshape(prior.dim, prior.dim), prior) for n, s, o in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["k", "log_marg"])

    return outer.select("k", "n", "s", "outer").mapInArrow(score, "k bigint, log_marg double")


def map_estimate(n: int, s: np.ndarray, outer: np.ndarray, prior: ConjugatePrior) -> tuple[np.ndarray, np.ndarray]:
    """Most probable mean and covariance of a full component: the divisor is ``v_N + D + 2``."""
    _, v_n, m_n, s_n = full_posterior(n, s, outer, prior)
    return m_n, s_n / (v_n + prior.dim + 2)


def draw_component(family: str, n: int, s: np.ndarray, second: np.ndarray, prior: FixedPrior | ConjugatePrior, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray | None]:
    """A mean and a (co)variance from a component's posterior. ``second``: squares for diag, outer products for
    full; the fixed family draws a mean alone. The Wishart draw is Bartlett's, with a degree less a row."""
    if family == "fixed":
        precision = 1 / np.array(prior.var_0) + n / np.array(prior.var)
        mean = (np.array(prior.mu_0) / np.array(prior.var_0) + s / np.array(prior.var)) / precision
        return rng.normal(mean, np.sqrt(1 / precision)), None
    if family == "diag":
        m_0, s_0 = np.array(prior.m_0), np.array(prior.s_0)
        k_n, v_n = prior.k_0 + n, prior.v_0 + n
        m_n = (prior.k_0 * m_0 + s) / k_n
        s_n = s_0 + second + prior.k_0 * m_0**2 - k_n * m_n**2
        var = s_n / rng.chisquare(v_n, len(s))
        return rng.normal(m_n, np.sqrt(var / k_n)), var
    k_n, v_n, m_n, s_n = full_posterior(n, s, second, prior)
    d = prior.dim
    a = np.tril(rng.normal(size=(d, d)), -1) + np.diag(np.sqrt(rng.chisquare(v_n - np.arange(d))))
    factor = np.linalg.cholesky(np.linalg.inv(s_n)) @ a
    cov = np.linalg.inv(factor @ factor.T)
    return rng.multivariate_normal(m_n, cov / k_n), cov
