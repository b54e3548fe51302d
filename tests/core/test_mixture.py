import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.operators import gibbs, mixture
from murmuration.operators.mixture import ConjugatePrior, FixedPrior

X = np.random.default_rng(17).normal(size=(4, 3)).round(3)


def frames(spark, x=X, z=(0, 0, 1, 0)):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seg_id bigint, x array<double>"), spark.createDataFrame([(i, int(k)) for i, k in enumerate(z)], "seg_id bigint, k bigint")


def prior(family, d=3):
    if family == "fixed":
        return FixedPrior([0.3, 0.2, 0.5][:d], [0.25, -0.3, 0.0][:d], [2.0, 1.0, 1.5][:d])
    return ConjugatePrior([0.25, -0.3, 0.0][:d], 1.7, 6.0, [0.5] * d if family == "diag" else (0.5 * np.eye(d)).tolist())


def test_statistics(spark):
    df, z = frames(spark, z=(0, 0, 1, -1))
    got = {r["k"]: r for r in mixture.component_stats(df, z).collect()}
    assert set(got) == {0, 1} and got[0]["n"] == 2
    assert got[0]["s"] == pytest.approx(X[:2].sum(0)) and got[0]["ss"] == pytest.approx((X[:2] ** 2).sum(0))
    outer = {r["k"]: np.array(r["outer"]).reshape(3, 3) for r in mixture.component_outer(df, z).collect()}
    assert np.allclose(outer[0], X[:2].T @ X[:2])


@pytest.mark.parametrize("family", ["fixed", "diag", "full"])
def test_marginal_is_the_product_of_predictives(family):
    """p(x1, ..., xn) by the chain rule, against the closed form."""
    z = np.full(len(X), -1)
    c = gibbs.Components(X, prior(family), family, 3, z)
    chain = 0.0
    for i in range(len(X)):
        if i == 0:
            c.add(0, 0)
            one = gibbs.Components(X[:1], prior(family), family, 1, np.zeros(1, int))
            chain = one.log_marg_data()
        else:
            chain += c.log_pred(i)[0]
            c.add(i, 0)
    assert c.log_marg_data() == pytest.approx(chain)


def test_expressions_equal_the_kernel(spark):
    df, z = frames(spark)
    for family, f in (("fixed", mixture.log_marginal_fixed), ("diag", mixture.log_marginal_diag)):
        got = {r["k"]: r["log_marg"] for r in f(mixture.component_stats(df, z), prior(family)).collect()}
        c = gibbs.Components(X, prior(family), family, 2, np.array([0, 0, 1, 0]))
        assert got[0] + got[1] == pytest.approx(c.log_marg_data())
        params = mixture.predictive_arrays(mixture.predictive_parameters(mixture.component_stats(df, z), prior(family)))
        pred = mixture.log_predictive(X, *params[2:])
        for i in range(len(X)):
            assert pred[i] == pytest.approx(c.log_pred(i))
        best = {r["seg_id"]: (r["k"], r["log_pred"]) for r in mixture.score_predictive(df, mixture.component_stats(df, z), prior(family)).collect()}
        assert {i: k for i, (k, _) in best.items()} == dict(enumerate(pred.argmax(1).tolist()))


def test_full_family_equals_the_kernel(spark):
    df, z = frames(spark)
    c = gibbs.Components(X, prior("full"), "full", 2, np.array([0, 0, 1, 0]))
    total = 0.0
    tables = {r["k"]: r for r in mixture.map_table(mixture.component_outer(df, z), prior("full")).collect()}
    marginals = {r["k"]: r["log_marg"] for r in mixture.marginals_full(mixture.component_outer(df, z), prior("full")).collect()}
    for r in mixture.component_outer(df, z).collect():
        outer = np.array(r["outer"]).reshape(3, 3)
        total += mixture.log_marginal_full(r["n"], np.array(r["s"]), outer, prior("full"))
        pred = mixture.log_predictive_full(X, r["n"], np.array(r["s"]), outer, prior("full"))
        assert pred == pytest.approx([c.log_pred(i)[r["k"]] for i in range(len(X))])
        assert marginals[r["k"]] == pytest.approx(mixture.log_marginal_full(r["n"], np.array(r["s"]), outer, prior("full")))
        m, cov = mixture.map_estimate(r["n"], np.array(r["s"]), outer, prior("full"))
        k_n, v_n, m_n, s_n = mixture.full_posterior(r["n"], np.array(r["s"]), outer, prior("full"))
        assert np.allclose(m, m_n) and np.allclose(cov, s_n / (v_n + 5))
        assert np.allclose(tables[r["k"]]["mean"], m) and np.allclose(np.array(tables[r["k"]]["cov"]).reshape(3, 3), cov)
    assert total == pytest.approx(c.log_marg_data())


def test_assignment_probability(spark):
    df, z = frames(spark)
    got = mixture.log_prior_assignments(mixture.component_stats(df, z), 1.5, 6).first()[0]
    a = 1.5 / 6
    want = math.lgamma(1.5) - math.lgamma(5.5) + math.lgamma(3 + a) + math.lgamma(1 + a) - 2 * math.lgamma(a)
    assert got == pytest.approx(want)
    s = gibbs.Sampler(gibbs.Components(X, prior("fixed"), "fixed", 6, np.array([0, 0, 1, 0])), 1.5, np.random.default_rng(0))
    assert s.log_marg() == pytest.approx(want + s.components.log_marg_data())


@pytest.mark.parametrize("family", ["fixed", "diag", "full"])
@settings(max_examples=8, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_sweeps_keep_statistics(family, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 3))
    s = gibbs.Sampler(gibbs.Components(x, prior(family), family, 6, gibbs.initial_assignments(30, 6, "rand", rng)), 1.0, rng)
    for _ in range(3):
        s.sweep()
        c = s.components
        again = gibbs.Components(x, prior(family), family, 6, c.z)
        assert again.k == c.k and (again.n == c.n).all()
        for a, b in ((again.s, c.s), (again.q, c.q), (again.mu, c.mu), (again.log_det, c.log_det), (again.inv, c.inv)):
            assert np.allclose(a, b)


def test_adding_and_removing_restores():
    c = gibbs.Components(X, prior("full"), "full", 3, np.array([0, 0, -1, -1]))
    before = c.log_pred(3)
    c.add(2, 0)
    c.remove(2)
    assert np.allclose(c.log_pred(3), before)
    with pytest.raises(ValueError):
        gibbs.Components(X, prior("full"), "full", 3, np.array([0, 2, 2, 0]))


def test_prior_of_the_fixed_family_uses_the_prior_precision_alone():
    p = prior("fixed")
    c = gibbs.Components(X, p, "fixed", 3, np.full(4, -1))
    want = [-0.5 * sum(math.log(2 * math.pi * v) + (x - m) ** 2 / v for x, m, v in zip(row, p.mu_0, p.var_0)) for row in X]
    assert c.log_prior == pytest.approx(want)


@pytest.mark.parametrize("values", [1 << 20, 1])
def test_best_components_in_one_block_and_in_several(spark, monkeypatch, values):
    monkeypatch.setattr(mixture, "MAX_VALUES", values)
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(40, 3)), np.arange(40) % 4
    x += z[:, None]
    df, labels = frames(spark, x, z)
    outer = mixture.component_outer(df, labels)
    full = {r["seg_id"]: (r["k"], r["log_pred"]) for r in mixture.score_predictive_full(df, outer, prior("full")).collect()}
    p = np.stack([mixture.log_predictive_full(x, 10, x[z == k].sum(0), x[z == k].T @ x[z == k], prior("full")) for k in range(4)], 1)
    assert full == {i: (int(p[i].argmax()), pytest.approx(p[i].max())) for i in range(40)}
    for family in ("fixed", "diag"):
        stats = mixture.component_stats(df, labels)
        got = {r["seg_id"]: (r["k"], r["log_pred"]) for r in mixture.score_predictive(df, stats, prior(family)).collect()}
        p = mixture.log_predictive(x, *mixture.predictive_arrays(mixture.predictive_parameters(stats, prior(family)))[2:])
        assert got == {i: (int(p[i].argmax()), pytest.approx(p[i].max())) for i in range(40)}
    if values == 1:
        with pytest.raises(ValueError):
            mixture.assignment_posteriors(df, mixture.component_stats(df, labels), prior("diag"), 1.0, 4)


def test_draw():
    p = np.array([0.2, 0.5, 0.3])
    assert [gibbs.draw(p, u) for u in (0.0, 0.19, 0.21, 0.69, 0.71, 1.0)] == [0, 0, 1, 1, 2, 2]


def test_operator_is_repeatable_resumes_and_finds_blobs(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.1 + c for c in ([0, 5], [5, 0], [-5, -5])])
    df, _ = frames(spark, x, [0] * 60)
    p = FixedPrior([0.05] * 2, [0.0] * 2, [10.0] * 2)
    a, trace = gibbs.fbgmm(df, p, 10, n_iter=15, seed=3)
    b, _ = gibbs.fbgmm(df.repartition(3), p, 10, n_iter=15, seed=3)
    got = {r["seg_id"]: r["k"] for r in a.collect()}
    assert got == {r["seg_id"]: r["k"] for r in b.collect()}
    assert all(len({got[i] for i in range(s, s + 20)}) == 1 for s in (0, 20, 40)) and len(set(got.values())) == 3
    rows = trace.orderBy("iter").collect()
    assert [r["iter"] for r in rows] == list(range(1, 16)) and rows[-1]["components_recorded"] == 2
    gibbs.save_checkpoint(spark, str(tmp_path), a, trace, 9)
    gibbs.save_checkpoint(spark, str(tmp_path), a, trace, 15)
    last, state, _ = gibbs.resume(spark, str(tmp_path))
    assert last == 15
    c, more = gibbs.fbgmm(df, p, 10, n_iter=2, seed=3, start=state, first_iter=last + 1)
    assert {r["iter"] for r in more.collect()} == {16, 17} and len({r["k"] for r in c.collect()}) == 3
    assert gibbs.resume(spark, str(tmp_path / "none")) is None
    assert gibbs.fbgmm(df.limit(0), p, 3)[0].count() == 0
    own, _ = gibbs.fbgmm(df.limit(8), p, 1, n_iter=1, init="each-in-own")
    assert own.count() == 8


@pytest.mark.parametrize("family", ["fixed", "diag", "full"])
def test_posterior_draws(family):
    rng = np.random.default_rng(1)
    second = X.T @ X if family == "full" else (X**2).sum(0)
    draws = [mixture.draw_component(family, len(X), X.sum(0), second, prior(family), rng) for _ in range(3000)]
    mean = np.mean([m for m, _ in draws], 0)
    c = gibbs.Components(X, prior(family), family, 1, np.zeros(4, int))
    assert np.allclose(mean, c.mu[0], atol=0.08)
    if family == "full":  # an inverse Wishart has the mean S_N / (v_N - D - 1)
        _, v_n, _, s_n = mixture.full_posterior(4, X.sum(0), X.T @ X, prior("full"))
        assert np.allclose(np.mean([s for _, s in draws], 0), s_n / (v_n - 4), rtol=0.2, atol=0.03)


def test_prior_from_data(spark):
    df, _ = frames(spark)
    p = mixture.fixed_prior(df)
    assert p.var == pytest.approx(((X.var(0) + 1e-6) * 0.1).tolist()) and p.var_0 == pytest.approx([v / 0.05 for v in p.var])
    with pytest.raises(ValueError):
        ConjugatePrior([0.0] * 3, 1.0, 2.0, [1.0] * 3)
