"""Exact finite-population tails as Spark expressions.

Arguments are SQL expressions (usually column names) or numbers, results are
columns. Sums run in log space, term by term, so they neither overflow nor lose
the tail when the first term underflows. A fold is at most as long as the number
of labels, never as long as the pool; binomial coefficients take constant time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Arg = str | int | float


def _long(x: Arg) -> str:
    return f"CAST({x} AS BIGINT)"


def _dbl(x: Arg) -> str:
    return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS DOUBLE)"


# ln n! below the range where the series is exact to the last digits
_SMALL = 20
_SMALL_LN = "array(" + ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(_SMALL)) + ")"
_HALF_LN_2PI = f"{0.5 * math.log(2 * math.pi)!r}D"


def _series(x: str) -> str:
    """Stirling's correction to ln x!, x >= 20."""
    return f"(1D/12 - (1D/360 - (1D/1260 - 1D/1680/({x}*{x}))/({x}*{x}))/({x}*{x}))/{x}"


def _ln_factorial(n: str) -> str:
    x = f"CAST({n} AS DOUBLE)"
    big = f"({x} + 0.5D) * ln({x}) - {x} + {_HALF_LN_2PI} + {_series(x)}"
    return f"(CASE WHEN {n} < {_SMALL} THEN element_at({_SMALL_LN}, CAST(greatest({n}, 0) AS INT) + 1) ELSE {big} END)"


def _ln_choose(a: str, b: str) -> str:
    """ln C(a, b) for 0 <= b <= a, accurate for pools of any size.

    ln a!/(a-r)! is evaluated as one expression: the difference of two
    log-factorials would lose the digits that matter when a is large. The
    one-element array binds the arguments to a name, so they are computed once.
    """
    x, r, y = "CAST(c.n AS DOUBLE)", "CAST(c.r AS DOUBLE)", "CAST(c.n - c.r AS DOUBLE)"
    falling = f"{r} * ln({x}) - ({y} + 0.5D) * log1p(-{r} / {x}) - {r} + {_series(x)} - {_series(y)}"
    top = f"CASE WHEN c.n - c.r < {_SMALL} THEN {_ln_factorial('c.n')} - {_ln_factorial('(c.n - c.r)')} ELSE {falling} END"
    value = f"CASE WHEN c.r >= 1 THEN ({top}) - {_ln_factorial('c.r')} ELSE 0D END"
    return f"transform(array(struct({a} AS n, least({b}, {a} - {b}) AS r)), c -> {value})[0]"


def _ln_pmf(j: str, pop: str, bad: str, draws: str) -> str:
    return (
        f"({_ln_choose(bad, j)} + {_ln_choose(f'({pop} - {bad})', f'({draws} - {j})')} - {_ln_choose(pop, draws)})"
    )


def _support(pop: str, bad: str, draws: str) -> tuple[str, str]:
    return f"greatest(CAST(0 AS BIGINT), {draws} - ({pop} - {bad}))", f"least({draws}, {bad})"


def _step(j: str, pop: str, bad: str, draws: str) -> str:
    """ln pmf(j + 1) - ln pmf(j)."""
    up = f"CAST({bad} - {j} AS DOUBLE) * CAST({draws} - {j} AS DOUBLE)"
    down = f"CAST({j} + 1 AS DOUBLE) * CAST({pop} - {bad} - {draws} + {j} + 1 AS DOUBLE)"
    return f"(ln({up}) - ln({down}))"


def _sum_terms(first: str, last: str, pop: str, bad: str, draws: str) -> str:
    return (
        f"least(1D, aggregate(sequence({first}, {last}), "
        f"named_struct('t', {_ln_pmf(first, pop, bad, draws)}, 's', 0D), "
        f"(z, j) -> named_struct('t', CASE WHEN j < {last} THEN z.t + {_step('j', pop, bad, draws)} ELSE z.t END, "
        f"'s', z.s + exp(z.t)), z -> z.s))"
    )


def _bind(body: str, **args: str) -> str:
    """Evaluate the arguments once and read them in ``body`` as ``v.name``."""
    packed = ", ".join(f"{v} AS {k}" for k, v in args.items())
    return f"transform(array(struct({packed})), v -> {body})[0]"


def _named(pop: Arg, bad: Arg, draws: Arg, **more: Arg) -> dict[str, str]:
    return {k: _long(v) for k, v in {"pop": pop, "bad": bad, "draws": draws, **more}.items()}


_HYPER = ("v.pop", "v.bad", "v.draws")
_LO, _HI = _support(*_HYPER)


def hypergeom_pmf(j: Arg, pop: Arg, bad: Arg, draws: Arg) -> Column:
    inside = f"v.j >= {_LO} AND v.j <= {_HI}"
    body = f"CASE WHEN {inside} THEN exp({_ln_pmf('v.j', *_HYPER)}) ELSE 0D END"
    return F.expr(_bind(body, **_named(pop, bad, draws, j=j)))


def _cdf(k: str, pop: str, bad: str, draws: str) -> str:
    lo, hi = _support(pop, bad, draws)
    return f"CASE WHEN {k} < {lo} THEN 0D WHEN {k} >= {hi} THEN 1D ELSE {_sum_terms(lo, k, pop, bad, draws)} END"


def _tail(k: str, pop: str, bad: str, draws: str) -> str:
    lo, hi = _support(pop, bad, draws)
    return f"CASE WHEN {k} <= {lo} THEN 1D WHEN {k} > {hi} THEN 0D ELSE {_sum_terms(k, hi, pop, bad, draws)} END"


def hypergeom_cdf(k: Arg, pop: Arg, bad: Arg, draws: Arg) -> Column:
    """P(X <= k), X the bad rows among ``draws`` taken from ``pop`` holding ``bad``."""
    return F.expr(_bind(_cdf("v.k", *_HYPER), **_named(pop, bad, draws, k=k)))


def hypergeom_tail(k: Arg, pop: Arg, bad: Arg, draws: Arg) -> Column:
    """P(X >= k)."""
    return F.expr(_bind(_tail("v.k", *_HYPER), **_named(pop, bad, draws, k=k)))


def _least_bad(alpha: Arg, n_sel: Arg) -> str:
    return f"(CAST({_dbl(alpha)} * {_dbl(n_sel)} AS BIGINT) + 1)"


def least_bad(alpha: Arg, n_sel: Arg) -> Column:
    """The smallest bad count above the target; the product is a DOUBLE, truncated."""
    return F.expr(_least_bad(alpha, n_sel))


def p_upper(k: Arg, m: Arg, n_sel: Arg, alpha: Arg) -> Column:
    """p-value of "the kept set has more than ``alpha`` bad rows"."""
    body = f"CASE WHEN v.draws = 0 OR v.bad > v.pop THEN 1D ELSE {_cdf('v.k', *_HYPER)} END"
    return F.expr(_bind(body, pop=_long(n_sel), bad=_least_bad(alpha, n_sel), draws=_long(m), k=_long(k)))


def p_lower(k: Arg, m: Arg, n_sel: Arg, beta: Arg) -> Column:
    """p-value of "the kept set has less than a ``beta`` share of wanted rows"."""
    kd = f"(CAST(ceil({_dbl(beta)} * {_dbl(n_sel)}) AS BIGINT) - 1)"
    body = f"CASE WHEN v.draws = 0 OR v.bad < 0 THEN 1D ELSE {_tail('v.k', *_HYPER)} END"
    return F.expr(_bind(body, pop=_long(n_sel), bad=kd, draws=_long(m), k=_long(k)))


def critical_count(m: Arg, n_sel: Arg, alpha: Arg, delta: float) -> Column:
    """Largest k that still rejects at ``delta``; below the support when none does.

    The answer lies below the median, and 12 deviations further down nothing
    adds to ``delta``, so the fold covers a few deviations only.
    """
    mean = "CAST(v.draws AS DOUBLE) * v.bad / v.pop"
    dev = f"sqrt(greatest({mean} * (1 - CAST(v.bad AS DOUBLE) / v.pop), 0D))"
    lo = f"greatest({_LO}, CAST(floor({mean} - 12 * {dev} - 12) AS BIGINT))"
    hi = f"least({_HI}, CAST(ceil({mean} + {dev} + 2) AS BIGINT))"
    found = (
        f"aggregate(sequence({lo}, {hi}), named_struct('t', {_ln_pmf(lo, *_HYPER)}, 's', 0D, 'k', {lo} - 1), "
        f"(z, j) -> named_struct('t', CASE WHEN j < {hi} THEN z.t + {_step('j', *_HYPER)} ELSE z.t END, "
        f"'s', z.s + exp(z.t), "
        f"'k', CASE WHEN z.s + exp(z.t) <= {_dbl(delta)} AND j < {_HI} THEN j ELSE z.k END), z -> z.k)"
    )
    body = f"CASE WHEN v.bad > v.pop THEN v.draws ELSE {found} END"
    return F.expr(_bind(body, pop=_long(n_sel), bad=_least_bad(alpha, n_sel), draws=_long(m)))


def _binomial_tail(s: str, n: str, p: str) -> str:
    """P(X >= s) for X ~ Binomial(n, p), 0 < p < 1, 1 <= s <= n."""
    odds = f"(ln({p}) - log1p(-{p}))"
    start = f"{_ln_choose(n, s)} + {s} * ln({p}) + ({n} - {s}) * log1p(-{p})"
    return (
        f"least(1D, aggregate(sequence({s}, {n}), named_struct('t', {start}, 's', 0D), "
        f"(z, j) -> named_struct('t', CASE WHEN j < {n} THEN z.t + ln(CAST({n} - j AS DOUBLE)) "
        f"- ln(CAST(j + 1 AS DOUBLE)) + {odds} ELSE z.t END, 's', z.s + exp(z.t)), z -> z.s))"
    )


def clopper_pearson_lower(s: Arg, n: Arg, delta: float, steps: int = 50) -> Column:
    """One-sided lower confidence bound on a share, by bisection on the binomial tail."""
    half = (
        f"transform(array((b.lo + b.hi) / 2), p -> CASE WHEN {_binomial_tail('v.s', 'v.n', 'p')} > {_dbl(delta)} "
        f"THEN named_struct('lo', b.lo, 'hi', p) ELSE named_struct('lo', p, 'hi', b.hi) END)[0]"
    )
    bound = (
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> {half}, b -> (b.lo + b.hi) / 2)"
    )
    return F.expr(_bind(f"CASE WHEN v.s > 0 THEN {bound} ELSE 0D END", s=_long(s), n=_long(n)))


def sufficient_budget(n_pool: Arg, n1: Arg, margin: Arg, delta: float, target: float) -> Column:
    """Closed-form label budget that reaches ``target`` power; NULL without margin."""
    share = f"({_dbl(n1)} / {_dbl(n_pool)})"
    miss = f"ln(2D / (1D - {_dbl(target)}))"
    need = f"2D * greatest(ln(1D / {_dbl(delta)}), {miss}) / ({_dbl(margin)} * {_dbl(margin)})"
    value = f"CAST(ceil(2D * ({need}) / {share} + 2D * {miss} / ({share} * {share})) AS BIGINT)"
    return F.expr(f"CASE WHEN {_dbl(margin)} > 0 THEN {value} END")
