"""Finite Bayesian Gaussian mixture by collapsed Gibbs sampling.

A sweep is sequential by definition: each vector's draw depends on the draws before it. A sweep is therefore one
task with a numpy kernel; a parallel approximation is not put in its place. The task holds the vectors, so their
number is bounded by ``MAX_ROWS``, and an error is raised beyond it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrowtools import joined, matrix
from ..session import write_table
from .mixture import LOG_2PI, LOG_PI, ConjugatePrior, FixedPrior, log_marginal_full

MAX_ROWS = 2_000_000


def initial_assignments(n: int, k: int, how: str, rng: np.random.Generator) -> np.ndarray:
    """``rand``: uniform over k components, then numbered without gaps; ``each-in-own``: one each."""
    if how == "each-in-own":
        return np.arange(n)
    if how != "rand":
        raise ValueError("how is 'rand' or 'each-in-own'")
    return np.unique(rng.integers(0, k, n), return_inverse=True)[1] if n else np.zeros(0, np.int64)


class Components:
    """Statistics of up to ``k_max`` components; the active ones are numbered from 0 without gaps."""

    def __init__(self, x: np.ndarray, prior: FixedPrior | ConjugatePrior, family: str, k_max: int, z: np.ndarray) -> None:
        labels = set(z.tolist()) - {-1}
        if labels != set(range(len(labels))):
            raise ValueError("components must be numbered from 0 without gaps; -1 is unassigned")
        if len(labels) > k_max:
            raise ValueError("more components than k_max")
        self.x, self.family, self.k_max, self.z = x, family, k_max, z.astype(np.int64).copy()
        n, self.d = x.shape
        self.prior = prior
        self.n, self.s = np.zeros(k_max, np.int64), np.zeros((k_max, self.d))
        self.q = np.zeros((k_max, self.d, self.d) if family == "full" else (k_max, self.d))
        self.k = len(labels)
        for c in range(self.k):
            own = x[self.z == c]
            self.n[c], self.s[c] = len(own), own.sum(0)
            self.q[c] = own.T @ own if family == "full" else (own**2).sum(0)
        if family == "fixed":
            self.prec, self.prec_0, self.m_0 = 1 / np.array(prior.var), 1 / np.array(prior.var_0), np.array(prior.mu_0)
        else:
            self.m_0, self.s_0 = np.array(prior.m_0), np.array(prior.s_0, float)
            top = n + prior.v_0 + self.d + 2
            self.half_gamma = [math.lgamma(max(v, 1e-9) / 2) for v in np.arange(0, math.ceil(top) + 1) + (prior.v_0 % 1)]
        self.mu, self.log_det = np.zeros((k_max, self.d)), np.zeros(k_max)
        self.inv = np.zeros((k_max, self.d, self.d) if family == "full" else (k_max, self.d))
        for c in range(self.k):
            self._refresh(c)
        self.log_prior = self._log_prior()

    def _gamma(self, v: np.ndarray) -> np.ndarray:
        return np.array([self.half_gamma[i] for i in np.floor(v).astype(int)])

    def _posterior(self, n: float, s: np.ndarray, q: np.ndarray) -> tuple:
        """Mean, log determinant and inverse of the scale, of the posterior predictive."""
        if self.family == "fixed":
            prec_n = self.prec_0 + n * self.prec
            pred = prec_n * self.prec / (prec_n + self.prec)
            return (self.prec_0 * self.m_0 + self.prec * s) / prec_n, -np.log(pred).sum(), pred
        k_n, v_n = self.prior.k_0 + n, self.prior.v_0 + n
        m = (self.prior.k_0 * self.m_0 + s) / k_n
        if self.family == "diag":
            var = (k_n + 1) / (k_n * v_n) * (self.s_0 + self.prior.k_0 * self.m_0**2 + q - k_n * m**2)
            return m, np.log(var).sum(), 1 / var
        cov = (k_n + 1) / (k_n * (v_n - self.d + 1)) * (self.s_0 + self.prior.k_0 * np.outer(self.m_0, self.m_0) + q - k_n * np.outer(m, m))
        return m, np.linalg.slogdet(cov)[1], np.linalg.inv(cov)

    def _refresh(self, c: int) -> None:
        self.mu[c], self.log_det[c], self.inv[c] = self._posterior(self.n[c], self.s[c], self.q[c])

    def _density(self, delta: np.ndarray, log_det: np.ndarray, inv: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.family == "fixed":
            return -0.5 * (self.d * LOG_2PI + log_det + (delta**2 * inv).sum(-1))
        if self.family == "diag":
            v = self.prior.v_0 + n
            c = self._gamma(v + 1) - self._gamma(v) - 0.5 * (np.log(v) + LOG_PI)
            return self.d * c - 0.5 * log_det - (v + 1) / 2 * np.log1p(delta**2 * inv / v[:, None]).sum(-1)
        v = self.prior.v_0 + n - self.d + 1
        far = np.einsum("ki,kij,kj->k", delta, inv, delta)
        return self._gamma(v + self.d) - self._gamma(v) - self.d / 2 * (np.log(v) + LOG_PI) - 0.5 * log_det - (v + self.d) / 2 * np.log1p(far / v)

    def _log_prior(self) -> np.ndarray:
        """Density of each vector under an empty component. In the fixed family the prior's precision alone
        counts, without that of the data."""
        if self.family == "fixed":
            return -0.5 * (self.d * LOG_2PI - np.log(self.prec_0).sum() + ((self.x - self.m_0) ** 2 * self.prec_0).sum(1))
        zero = np.zeros_like(self.q[0])
        m, log_det, inv = self._posterior(0, np.zeros(self.d), zero)
        return np.array([self._density((x - m)[None], np.array([log_det]), inv[None], np.zeros(1))[0] for x in self.x])

    def log_pred(self, i: int) -> np.ndarray:
        """Log predictive density of vector i under the active components."""
        k = self.k
        return self._density(self.mu[:k] - self.x[i], self.log_det[:k], self.inv[:k], self.n[:k])

    def add(self, i: int, c: int) -> None:
        if c == self.k:
            self.k += 1
        x = self.x[i]
        self.n[c] += 1
        self.s[c] += x
        self.q[c] += np.outer(x, x) if self.family == "full" else x**2
        self._refresh(c)
        self.z[i] = c

    def remove(self, i: int) -> None:
        c = self.z[i]
        if c < 0:
            return
        x = self.x[i]
        self.z[i] = -1
        self.n[c] -= 1
        if self.n[c]:
            self.s[c] -= x
            self.q[c] -= np.outer(x, x) if self.family == "full" else x**2
            self._refresh(c)
            return
        last = self.k - 1  # the last component takes the empty one's number
        for a in (self.n, self.s, self.q, self.mu, self.log_det, self.inv):
            a[c] = a[last]
            a[last] = 0
        self.z[self.z == last] = c
        self.k = last

    def saved(self, c: int) -> tuple:
        return tuple(np.copy(a[c]) for a in (self.n, self.s, self.q, self.mu, self.log_det, self.inv))

    def restore(self, i: int, c: int, saved: tuple) -> None:
        for a, v in zip((self.n, self.s, self.q, self.mu, self.log_det, self.inv), saved):
            a[c] = v
        self.z[i] = c

    def log_marg_data(self) -> float:
        """Log probability of the data given the assignments."""
        return sum(self._log_marg(c) for c in range(self.k))

    def _log_marg(self, c: int) -> float:
        n, s, q = float(self.n[c]), self.s[c], self.q[c]
        if self.family == "fixed":
            v, w, m = 1 / self.prec, 1 / self.prec_0, self.m_0
            spread = n * w + v
            fit = (s**2 * w / v + m**2 * v / w + 2 * s * m) / spread
            return float((-(n - 1) / 2 * np.log(v) - n / 2 * LOG_2PI - 0.5 * np.log(spread) - q / (2 * v) - m**2 / (2 * w) + fit / 2).sum())
        if self.family == "full":
            return float(log_marginal_full(int(n), s, q, self.prior))
        k_n, v_n = self.prior.k_0 + n, self.prior.v_0 + n
        m = (self.prior.k_0 * self.m_0 + s) / k_n
        s_n = self.s_0 + self.prior.k_0 * self.m_0**2 + q - k_n * m**2
        return float(-n * self.d / 2 * LOG_PI + self.d / 2 * (math.log(self.prior.k_0) - math.log(k_n)) + self.prior.v_0 / 2 * np.log(self.s_0).sum() - v_n / 2 * np.log(s_n).sum() + self.d * (math.lgamma(v_n / 2) - math.lgamma(self.prior.v_0 / 2)))


def draw(p: np.ndarray, u: float) -> int:
    """Index by inverse cumulative probability; the last one if rounding leaves u at the end."""
    return min(int(np.searchsorted(np.cumsum(p), u, side="right")), len(p) - 1)


@dataclass
class Sampler:
    """State of the chain: components, concentration, random numbers."""

    components: Components
    alpha: float
    rng: np.random.Generator

    def log_marg(self) -> float:
        """Log probability of data and assignments."""
        c, a = self.components, self.alpha / self.components.k_max
        counts = sum(math.lgamma(n + a) - math.lgamma(a) for n in c.n.tolist())
        return math.lgamma(self.alpha) - math.lgamma(self.alpha + int(c.n.sum())) + counts + c.log_marg_data()

    def sweep(self) -> dict:
        """Draw each vector's component anew, in order. The number of active components is recorded less one, as
        well as it is."""
        began, c = time.time(), self.components
        for i in range(len(c.x)):
            old, k_old = int(c.z[i]), c.k
            saved = c.saved(old) if old >= 0 else None
            c.remove(i)
            p = np.log(self.alpha / c.k_max + c.n)
            p[: c.k] += c.log_pred(i)
            p[c.k :] += c.log_prior[i]
            p = np.exp(p - p.max())
            k = min(draw(p / p.sum(), self.rng.random()), c.k)
            if saved is not None and k == old and c.k == k_old:
                c.restore(i, old, saved)
            else:
                c.add(i, k)
        return {"sample_time": time.time() - began, "log_marg": self.log_marg(), "components_recorded": c.k - 1, "active": c.k}


def fbgmm(vectors: DataFrame, prior: FixedPrior | ConjugatePrior, k_max: int, family: str = "fixed", alpha: float = 1.0, n_iter: int = 1, init: str = "rand", seed: int = 0, id_col: str = "seg_id", start: DataFrame | None = None, first_iter: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(id_col, k)`` after ``n_iter`` sweeps, and the trace ``iter, log_marg, components_recorded, active``.

    Vectors are taken in order of id. With ``init="each-in-own"`` there are as many components as vectors. ``start``
    (``id_col, k``) resumes from assignments. The sweeps run in one task; more than ``MAX_ROWS`` vectors are
    refused. Vectors that are null or not finite are left out.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    if start is not None:
        rows = rows.join(start.select(F.col(id_col).alias("id"), F.col("k").cast("bigint").alias("k")), "id", "left")
    else:
        rows = rows.withColumn("k", F.lit(None).cast("bigint"))
    fresh = start is None
    if rows.count() > MAX_ROWS:
        raise ValueError(f"a sweep is one task and takes at most {MAX_ROWS} vectors")

    def run(batches: object) -> object:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        batch = joined(parts)
        at, x = matrix(batch.column(1), len(batch.column(1)[0]))
        ids = batch.column(0).to_numpy()[at]
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        k = len(x) if init == "each-in-own" and fresh else k_max
        rng = np.random.default_rng([seed, first_iter])
        z = batch.column(2).fill_null(-1).to_numpy()[at][order] if not fresh else initial_assignments(len(x), k, init, rng)
        sampler = Sampler(Components(x, prior, family, max(k, int(z.max()) + 1), z), alpha, rng)
        trace = [sampler.sweep() for _ in range(n_iter)]
        n, t = len(ids), len(trace)
        # One table: rows with an id are assignments, the others are the trace.
        yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *[None] * t], pa.int64()), pa.array([*sampler.components.z.tolist(), *[r["active"] for r in trace]], pa.int64()), pa.array([None] * n + list(range(first_iter, first_iter + t)), pa.int32()), pa.array([None] * n + [r["log_marg"] for r in trace], pa.float64())], names=["id", "k", "iter", "log_marg"])

    out = write_table(rows.coalesce(1).mapInArrow(run, "id bigint, k bigint, iter int, log_marg double"), "gibbs").df
    trace = out.where("iter is not null").select("iter", "log_marg", (F.col("k") - 1).alias("components_recorded"), F.col("k").alias("active"))
    return out.where("iter is null").select(F.col("id").alias(id_col), "k"), trace


def save_checkpoint(spark: SparkSession, path: str, assignments: DataFrame, trace: DataFrame, iteration: int) -> None:
    """Write the state after an iteration below ``path``."""
    assignments.write.mode("overwrite").parquet(f"{path}/assignments/iteration={iteration}")
    trace.write.mode("overwrite").parquet(f"{path}/trace/iteration={iteration}")


def resume(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame] | None:
    """The latest iteration written below ``path``, its assignments and all of the trace; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/assignments")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    every = spark.read.parquet(f"{path}/assignments")
    last = every.agg(F.max("iteration").alias("i")).first()["i"]
    return int(last), every.where(F.col("iteration") == last).drop("iteration"), spark.read.parquet(f"{path}/trace").drop("iteration")
