"""Certification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.stats import p_lower, p_upper
from plumbline.operators import certify as C
from plumbline.operators import rates as R
from plumbline.operators.sampling import calibration_draw
from plumbline.plans import views as V
from plumbline.plans.registry import Tables, query

CAL_N = 60
BIG_N = 200
ALPHA, DELTA = 0.25, 0.10

DOCS = V.curve_sql("pool", "lex4", "unsafe")
DOCS_REQ = V.curve_sql("pool", "lex4", "unsafe", ("req",))
CAL = f"cal AS (SELECT * FROM pool ORDER BY {V.keyed_sql('cal', 0, 'doc_id')} LIMIT {CAL_N})"
CAL_BIG = f"cal AS (SELECT * FROM big ORDER BY {V.keyed_sql('cal', 0, 'event_id')} LIMIT {BIG_N})"


def _cal(t: Tables, seed: int = 0):
    return calibration_draw(V.pool(t), CAL_N, seed, V.IDS)


def _cal_big(t: Tables):
    return calibration_draw(V.pool_big(t), BIG_N, 0, ["event_id"])


@query("d01_grid_thresholds", f"WITH {V.POOL}, {DOCS} SELECT q100, n_pool, tau, n_sel FROM curve")
def d01(t):
    return C.grid_thresholds(V.pool(t), "lex4")


@query(
    "d01_grid_thresholds_stratified",
    f"WITH {V.HUGE}, {V.curve_sql('huge', 'score', 'unsafe', ('req',))} SELECT req, q100, n_pool, tau, n_sel FROM curve",
)
def d01s(t):
    return C.grid_thresholds(V.pool_huge(t), "score", ["req"])


CURVE_OUT = "q100, n_pool, tau, n_sel, k_sel, k_sel / n_sel AS bad_frac"


@query("d02_composition_curve", f"WITH {V.POOL}, {DOCS} SELECT {CURVE_OUT} FROM curve", "bad_frac")
def d02(t):
    return C.composition_curve(V.pool(t), "lex4", "unsafe")


@query(
    "d02_composition_curve_lineitem",
    f"WITH {V.HUGE}, {V.curve_sql('huge', 'score', 'unsafe')} SELECT {CURVE_OUT} FROM curve",
    "bad_frac",
)
def d02h(t):
    return C.composition_curve(V.pool_huge(t), "score", "unsafe")


P_UP = V.p_upper_sql("k", "m", "n_sel", str(ALPHA))
COUNTS = V.audit_sql("cal", "lex4", "unsafe")


@query(
    "d03_p_upper",
    f"WITH {V.POOL}, {CAL}, {DOCS}, {COUNTS}, a AS (SELECT *, unnest([0.05, 0.1, 0.25, 0.5]::DOUBLE[]) AS alpha FROM counts) "
    f"SELECT q100, alpha, m, k, n_sel, {V.p_upper_sql('k', 'm', 'n_sel', 'alpha')} AS p FROM a",
    "p",
)
def d03(t):
    c = C.audit_counts(V.pool(t), _cal(t), "lex4", {"k": C._flag("unsafe")}, [], C.GRID)
    a = c.select("q100", "m", "k", "n_sel", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.25, 0.5)])).alias("alpha"))
    return a.select("q100", "alpha", "m", "k", "n_sel", p_upper("k", "m", "n_sel", "alpha").alias("p"))


AUDIT_OUT = "q100, n_pool, tau, n_sel, m, k, p, passed, tested, deployed"
TESTED = f"tests AS (SELECT *, {P_UP} AS p FROM counts)"


@query(
    "d04_certify",
    f"WITH {V.POOL}, {CAL}, {DOCS}, {COUNTS}, {TESTED}, {V.walk_sql('tests', f'p <= {DELTA}')} SELECT {AUDIT_OUT} FROM audit",
    "p",
)
def d04(t):
    return C.certify(V.pool(t), _cal(t), "lex4", "unsafe", ALPHA, DELTA)


@query(
    "d04_certify_events",
    f"WITH {V.BIG}, {CAL_BIG}, {V.curve_sql('big', 'score', 'unsafe')}, {V.audit_sql('cal', 'score', 'unsafe')}, {TESTED}, "
    f"{V.walk_sql('tests', f'p <= {DELTA}')} SELECT {AUDIT_OUT} FROM audit",
    "p",
)
def d04e(t):
    return C.certify(V.pool_big(t), _cal_big(t), "score", "unsafe", ALPHA, DELTA)


@query(
    "d05_certify_first",
    f"WITH {V.POOL}, {CAL}, {V.curve_sql('pool', 'lex8', 'unsafe', grid='[85]')}, {V.audit_sql('cal', 'lex8', 'unsafe')}, {TESTED}, "
    f"{V.walk_sql('tests', f'p <= {DELTA}')} SELECT {AUDIT_OUT} FROM audit",
    "p",
)
def d05(t):
    return C.certify_first(V.pool(t), _cal(t), "lex8", "unsafe", ALPHA, DELTA)


FALLBACK = f"""lab AS (SELECT count(*) AS n_cal, sum((NOT unsafe)::INT)::BIGINT AS n_good FROM cal),
lb AS (SELECT n_cal, n_good, {V.cp_sql('n_good', 'n_cal', str(DELTA))} AS lower_bound FROM lab),
size AS (SELECT count(*) AS n_pool FROM pool),
keep AS (SELECT n_pool, n_cal, n_good, lower_bound, greatest(1, round_even(lower_bound * n_pool, 0)::BIGINT) AS keep FROM lb, size)"""


@query("d06_fallback_size", f"WITH {V.POOL}, {CAL}, {FALLBACK} SELECT * FROM keep", "lower_bound")
def d06s(t):
    size = V.pool(t).agg(F.count(F.lit(1)).alias("n_pool"))
    return C.fallback_sizes(size, _cal(t), "unsafe", DELTA)


@query(
    "d06_cp_fallback",
    f"WITH {V.POOL}, {CAL}, {FALLBACK}, r AS (SELECT *, row_number() OVER (ORDER BY len_score DESC, {V.tie_sql('doc_id')}) AS rn FROM pool) "
    "SELECT doc_id, len_score, unsafe FROM r, keep WHERE rn <= keep.keep",
)
def d06(t):
    return C.cp_fallback(V.pool(t), _cal(t), "len_score", "unsafe", DELTA, V.IDS).select("doc_id", "len_score", "unsafe")


def chosen_sql(src: str, score: str, ident: str, alpha: str, delta: float, keys: tuple[str, ...], cols: str) -> str:
    """Certify each stratum or fall back inside it; the kept rows."""
    p = V.p_upper_sql("k", "m", "n_sel", alpha)
    sel = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    on = lambda a, b: " AND ".join([*(f"{a}.{k} = {b}.{k}" for k in keys), "TRUE"])
    return f"""{V.curve_sql(src, score, 'unsafe', keys)}, {V.audit_sql('cal', score, 'unsafe', keys)},
tests AS (SELECT *, {p} AS p FROM counts), {V.walk_sql('tests', f'p <= {delta}', keys)},
cut AS (SELECT {sel}bool_or(deployed) AS certified, max(n_pool) AS n_pool, max(CASE WHEN deployed THEN q100 END) AS q100,
 max(CASE WHEN deployed THEN tau END) AS tau, max(CASE WHEN deployed THEN n_sel END) AS n_sel FROM audit GROUP BY ALL),
lab AS (SELECT {sel}count(*) AS n_cal, sum((NOT unsafe)::INT)::BIGINT AS n_good FROM cal GROUP BY ALL),
lb AS (SELECT *, {V.cp_sql('n_good', 'n_cal', str(delta))} AS lower_bound FROM lab),
decided AS (SELECT c.*, lb.n_cal, lb.n_good, lb.lower_bound, greatest(1, round_even(lb.lower_bound * c.n_pool, 0)::BIGINT) AS keep
 FROM cut c JOIN lb ON {on('c', 'lb')}),
r AS (SELECT *, row_number() OVER ({part}ORDER BY {score} DESC, {V.tie_sql(ident)}) AS rn FROM {src}),
chosen AS (SELECT r.*, d.certified FROM r JOIN decided d ON {on('r', 'd')}
 WHERE CASE WHEN d.certified THEN r.{score} >= d.tau ELSE r.rn <= d.keep END)"""


@query(
    "d07_certified_selection",
    f"WITH {V.POOL}, {CAL}, {chosen_sql('pool', 'lex4', 'doc_id', str(ALPHA), DELTA, (), '')} SELECT doc_id, lex4, unsafe, certified FROM chosen",
)
def d07(t):
    kept, _ = C.certified_selection(V.pool(t), _cal(t), "lex4", "unsafe", ALPHA, DELTA, V.IDS)
    return kept.select("doc_id", "lex4", "unsafe", "certified")


@query(
    "d07_refused_selection",
    f"WITH {V.POOL}, {CAL}, {chosen_sql('pool', 'len_score', 'doc_id', '0.05', DELTA, (), '')} SELECT doc_id, len_score, unsafe, certified FROM chosen",
)
def d07r(t):
    kept, _ = C.certified_selection(V.pool(t), _cal(t), "len_score", "unsafe", 0.05, DELTA, V.IDS)
    return kept.select("doc_id", "len_score", "unsafe", "certified")


BETA = 0.2


@query(
    "d08_p_lower",
    f"WITH {V.POOL}, {CAL}, {V.curve_sql('pool', 'lex4', 'unsafe', wanted='demo')}, {V.audit_sql('cal', 'lex4', 'unsafe', wanted='demo')}, "
    "a AS (SELECT *, unnest([0.1, 0.2, 0.3, 0.4]::DOUBLE[]) AS beta FROM counts) "
    f"SELECT q100, beta, m, k_wanted, n_sel, {V.p_lower_sql('k_wanted', 'm', 'n_sel', 'beta')} AS p FROM a",
    "p",
)
def d08(t):
    c = C.audit_counts(V.pool(t), _cal(t), "lex4", {"k_wanted": C._flag("demo")}, [], C.GRID)
    a = c.select("q100", "m", "k_wanted", "n_sel", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])).alias("beta"))
    return a.select(
        "q100", "beta", "m", "k_wanted", "n_sel",
        p_lower("k_wanted", "m", "n_sel", "beta").alias("p"),
    )


@query(
    "d09_certify_two",
    f"WITH {V.POOL}, {CAL}, {V.curve_sql('pool', 'lex4', 'unsafe', wanted='demo')}, {V.audit_sql('cal', 'lex4', 'unsafe', wanted='demo')}, "
    f"tests AS (SELECT *, {V.p_upper_sql('k', 'm', 'n_sel', '0.3')} AS p_bad, {V.p_lower_sql('k_wanted', 'm', 'n_sel', str(BETA))} AS p_wanted FROM counts), "
    f"{V.walk_sql('tests', f'greatest(p_bad, p_wanted) <= {DELTA / 2}')} "
    "SELECT q100, n_pool, tau, n_sel, m, k, k_wanted, p_bad, p_wanted, passed, tested, deployed FROM audit",
    "p_bad p_wanted",
)
def d09(t):
    return C.certify_two(V.pool(t), _cal(t), "lex4", "unsafe", "demo", 0.3, BETA, DELTA)


@query(
    "d10_certify_stratified",
    f"WITH {V.POOL}, {CAL}, {chosen_sql('pool', 'lex4', 'doc_id', str(ALPHA), DELTA / 2, ('req',), '')} SELECT doc_id, req, lex4, unsafe, certified FROM chosen",
)
def d10(t):
    kept, _ = C.certified_selection(V.pool(t), _cal(t), "lex4", "unsafe", ALPHA, DELTA, V.IDS, ["req"])
    return kept.select("doc_id", "req", "lex4", "unsafe", "certified")


@query(
    "d10_certify_four_strata",
    f"WITH {V.POOL}, {CAL}, {chosen_sql('pool', 'lex4', 'doc_id', str(ALPHA), DELTA / 4, ('lang',), '')} SELECT doc_id, lang, lex4, unsafe, certified FROM chosen",
)
def d10four(t):
    """The four languages share the error: each is tested at a quarter of it."""
    kept, _ = C.certified_selection(V.pool(t), _cal(t), "lex4", "unsafe", ALPHA, DELTA, V.IDS, ["lang"])
    return kept.select("doc_id", "lang", "lex4", "unsafe", "certified")


@query(
    "k01_selection_meta",
    f"WITH {V.BIG}, {CAL_BIG}, {chosen_sql('big', 'score', 'event_id', '0.45', DELTA / 2, ('req',), '')} "
    "SELECT 'certified' AS arm, 0 AS seed, req, certified, n_pool, q100, tau, n_sel, n_cal, n_good, lower_bound, keep, 0.45::DOUBLE AS alpha FROM decided",
    "lower_bound",
)
def k01m(t):
    """Decisions are stored with the selection and read back."""
    from plumbline.plans.q_pool import _export
    from plumbline.sources import sinks as W

    run = {"arm": F.lit("certified"), "seed": F.lit(0)}

    def write(path):
        kept, decisions = C.certified_selection(V.pool_big(t), _cal_big(t), "score", "unsafe", 0.45, DELTA, ["event_id"], ["req"])
        W.write_selection(kept.withColumns(run).select("arm", "seed", "event_id"), path, decisions.withColumns(run))

    return W.read_decisions(t.spark, _export(t, "selection_meta", write))


@query(
    "d10_stratum_decisions",
    f"WITH {V.BIG}, {CAL_BIG}, {chosen_sql('big', 'score', 'event_id', '0.45', DELTA / 2, ('req',), '')} "
    "SELECT req, certified, n_pool, q100, tau, n_sel, n_cal, n_good, lower_bound, keep, 0.45::DOUBLE AS alpha FROM decided",
    "lower_bound",
)
def d10d(t):
    _, decisions = C.certified_selection(
        V.pool_big(t), _cal_big(t), "score", "unsafe", 0.45, DELTA, ["event_id"], ["req"]
    )
    return decisions


TARGETS = "CASE WHEN req THEN 0.35::DOUBLE ELSE 0.3::DOUBLE END"


@query(
    "d11_overall_bound",
    f"WITH {V.POOL}, {CAL}, {chosen_sql('pool', 'lex8', 'doc_id', TARGETS, DELTA / 2, ('req',), '')} "
    f"SELECT bool_and(certified) AS certified, count(*) AS n, avg({TARGETS}) AS overall_bound FROM chosen",
    "overall_bound",
)
def d11(t):
    target = F.when(F.col("req"), 0.35).otherwise(0.3)
    kept, _ = C.certified_selection(V.pool(t), _cal(t), "lex8", "unsafe", target, DELTA, V.IDS, ["req"])
    return C.overall_bound(kept)


# ---- rates. Each scored pool is one (pool, scorer) group of a long, narrow table.


def scored_pools(t: Tables):
    """(pool, scorer, score, unsafe, demo): documents under three scorers, events and line items under one."""
    pairs = F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(c).alias("score")) for s, c in (("lex4", "lex4"), ("lex8", "lex8"), ("len", "len_score"))])
    docs = V.pool(t).select(F.lit("docs").alias("pool"), "unsafe", "demo", F.inline(pairs))
    big = V.pool_big(t).select(F.lit("events").alias("pool"), "unsafe", "demo", F.lit("value").alias("scorer"), "score")
    return docs.unionByName(big)


SCORED = """scored AS (SELECT 'docs' AS pool, 'lex4' AS scorer, lex4 AS score, unsafe, demo FROM pool
 UNION ALL SELECT 'docs', 'lex8', lex8, unsafe, demo FROM pool UNION ALL SELECT 'docs', 'len', len_score, unsafe, demo FROM pool
 UNION ALL SELECT 'events', 'value', score, unsafe, demo FROM big)"""
KEYS = ("pool", "scorer")
NS = (50, 100, 200)
DRAWS = 100
RATE_ALPHAS = (0.10, 0.25)


def segments(t: Tables):
    def build():
        return R.kept_segments(scored_pools(t), "score", "unsafe", list(KEYS), "demo")

    return t.stored("segments", build)


SEGMENTS = V.curve_sql("scored", "score", "unsafe", KEYS, wanted="demo") + """,
segs AS (SELECT *, n_sel - coalesce(lag(n_sel) OVER w, 0) AS seg, k_sel - coalesce(lag(k_sel) OVER w, 0) AS seg_bad,
 w_sel - coalesce(lag(w_sel) OVER w, 0) AS seg_wanted FROM curve WINDOW w AS (PARTITION BY pool, scorer ORDER BY q100 DESC))"""
BASE = f"{V.POOL}, {V.BIG}, {SCORED}, {SEGMENTS}"


def draws_sql(ns=NS, draws=DRAWS) -> str:
    pick = "('0x' || substr(md5('mc:' || draw || ':' || n || ':' || i), 1, 15))::BIGINT % n_pool"
    need = "(ceil(8 * sqrt(few) - n_pool * ln(1 - least(few / n_pool, 0.5))) + 32)::BIGINT"

    def within(size: str) -> str:
        hits = f"len(list_filter(d.picks, lambda p: p >= s.n_sel - s.seg AND p < s.n_sel - s.seg + s.{size}))"
        return f"CASE WHEN d.few < d.n THEN s.{size} - {hits} ELSE {hits} END"

    return f"""jobs AS (SELECT *, least(n, greatest(n_pool - n, 0)) AS few FROM (SELECT DISTINCT pool, scorer, n_pool, n, draw FROM segs, unnest({list(ns)}) a(n), range(0, {draws}) b(draw))),
stream AS (SELECT *, {pick} AS p FROM (SELECT *, unnest(range(0, {need})) AS i FROM jobs)),
firsts AS (SELECT pool, scorer, n, draw, few, p, min(i) AS i FROM stream GROUP BY pool, scorer, n, draw, few, p),
taken AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY pool, scorer, n, draw ORDER BY i) <= few),
drawn AS (SELECT jobs.*, coalesce(picks, []::BIGINT[]) AS picks FROM jobs LEFT JOIN (SELECT pool, scorer, n, draw, list(p) AS picks FROM taken GROUP BY ALL) USING (pool, scorer, n, draw)),
hits AS (SELECT s.pool, s.scorer, d.n, d.draw, s.q100, s.n_pool, s.n_sel, s.k_sel,
 {within("seg")} AS m0, {within("seg_bad")} AS k0, {within("seg_wanted")} AS w0 FROM segs s JOIN drawn d USING (pool, scorer)),
sims AS (SELECT *, (sum(m0) OVER w)::BIGINT AS m, (sum(k0) OVER w)::BIGINT AS k, (sum(w0) OVER w)::BIGINT AS w FROM hits
 WINDOW w AS (PARTITION BY pool, scorer, n, draw ORDER BY q100 DESC ROWS UNBOUNDED PRECEDING))"""


def rates_sql(ok: str, by: str, target: str, src: str, where: str = "") -> str:
    return f"""tests AS (SELECT *, {ok} AS ok FROM {src} {where}),
walked AS (SELECT *, bool_and(ok) OVER (PARTITION BY {by}, draw ORDER BY q100 DESC ROWS UNBOUNDED PRECEDING) AS go FROM tests),
dep AS (SELECT {by}, draw, min(CASE WHEN go THEN q100 END) AS q, arg_min(n_sel, q100) FILTER (WHERE go) AS n_sel,
 arg_min(k_sel, q100) FILTER (WHERE go) AS k_sel FROM walked GROUP BY {by}, draw),
rates AS (SELECT {by}, count(*) AS draws, avg((q IS NOT NULL)::INT) AS cert_rate,
 avg(coalesce(k_sel / n_sel > {target}, false)::INT) AS false_rate, avg(q) / 100 AS mean_q,
 avg(k_sel / n_sel) AS mean_contam, avg(n_sel) AS mean_size FROM dep GROUP BY {by})"""


ALPHAS_SQL = f"sims2 AS (SELECT *, unnest({list(RATE_ALPHAS)}::DOUBLE[]) AS alpha FROM sims)"
BY = "pool, scorer, n, alpha"
OK = V.p_upper_sql("k", "m", "n_sel", "alpha") + f" <= {DELTA}"
RATE_COLS = "cert_rate false_rate mean_q mean_contam mean_size"


@query(
    "d12_certification_rate",
    f"WITH {BASE}, {draws_sql()}, {ALPHAS_SQL}, {rates_sql(OK, BY, 'alpha', 'sims2')} SELECT * FROM rates",
    RATE_COLS,
)
def d12(t):
    return R.certification_rate(segments(t), list(KEYS), list(NS), DRAWS, list(RATE_ALPHAS), DELTA)


@query(
    "d12_gate_rate",
    f"WITH {BASE}, {draws_sql()}, {ALPHAS_SQL}, {rates_sql(OK, BY, 'alpha', 'sims2', 'WHERE q100 = 85')} SELECT * FROM rates",
    RATE_COLS,
)
def d12g(t):
    return R.certification_rate(segments(t), list(KEYS), list(NS), DRAWS, list(RATE_ALPHAS), DELTA, deep=False)


OK2 = (
    f"greatest({V.p_upper_sql('k', 'm', 'n_sel', '0.25')}, {V.p_lower_sql('w', 'm', 'n_sel', '0.2')}) <= {DELTA / 2}"
)


@query(
    "d09_two_property_rate",
    f"WITH {BASE}, {draws_sql()}, {rates_sql(OK2, 'pool, scorer, n', '0.25', 'sims')} SELECT * FROM rates",
    RATE_COLS,
)
def d09r(t):
    return R.two_property_rate(segments(t), list(KEYS), list(NS), DRAWS, 0.25, F.lit(0.2), DELTA)


# exact power: the same finite sum, written over m and k
CELLS = f"""cells AS (SELECT pool, scorer, n_pool, n_sel AS n1, k_sel AS k1, k_sel / n_sel AS u1, alpha, alpha - k_sel / n_sel AS margin
 FROM segs, unnest({list(RATE_ALPHAS)}::DOUBLE[]) a(alpha) WHERE q100 = 85)"""


def power_sql(top: str) -> str:
    ks = "(trunc(alpha * n1)::BIGINT + 1)"
    return f"""mrows AS (SELECT *, {ks} AS ks, unnest(range(0, least({top}, n1) + 1)) AS m FROM cells),
krows AS (SELECT pool, scorer, alpha, n1, k1, m, ks, unnest(range(0, least(m, k1) + 1)) AS k FROM mrows),
power AS (SELECT pool, scorer, alpha, m, sum(CASE WHEN rej AND k >= greatest(0, m - (n1 - k1))
 THEN exp({V.lnc('k1', 'k')} + {V.lnc('n1 - k1', 'm - k')} - {V.lnc('n1', 'm')}) ELSE 0 END) AS power
 FROM (SELECT *, (ks > n1) OR {V.cdf_sql('k', 'n1', 'ks', 'm')} <= {DELTA} AS rej FROM krows) GROUP BY ALL)"""


def pred_sql(ns: str, top: str, where: str = "", within: str = "TRUE") -> str:
    mass = f"exp({V.lnc('n1', 'm')} + {V.lnc('n_pool - n1', 'ne - m')} - {V.lnc('n_pool', 'ne')})"
    return f"""{power_sql(top)},
mass AS (SELECT *, {mass} AS pm FROM (SELECT *, unnest(range(greatest(0, ne - (n_pool - n1)), least(ne, n1) + 1)) AS m
 FROM (SELECT *, least(n, n_pool) AS ne FROM (SELECT *, unnest({ns}) AS n FROM cells {where}) WHERE {within}))),
pred AS (SELECT pool, scorer, alpha, n, CASE WHEN max(trunc(alpha * n1)::BIGINT + 1) > max(n1) THEN 1.0 ELSE sum(pm * power) END AS pred
 FROM mass JOIN power USING (pool, scorer, alpha, m) WHERE pm >= 1e-12 GROUP BY pool, scorer, alpha, n)"""


@query(
    "d13_pr_certify",
    f"WITH {BASE}, {CELLS}, {pred_sql(str(list(NS)), str(max(NS)))} SELECT pool, scorer, alpha, n::BIGINT AS n, pred FROM pred",
    "pred",
)
def d13(t):
    cells = R.first_cells(segments(t), list(KEYS), list(RATE_ALPHAS))
    return R.pr_certify(cells, [*KEYS, "alpha"], DELTA, F.array(*[F.lit(n) for n in NS]))


LABELS_SQL = f"""WITH {BASE}, {draws_sql()}, {ALPHAS_SQL}, {rates_sql(OK, BY, 'alpha', 'sims2')}, {CELLS}, {pred_sql(str(list(NS)), str(max(NS)))},
sweep AS (SELECT r.pool, r.scorer, r.alpha, r.n::BIGINT AS n, r.cert_rate AS rate, r.false_rate AS false_cert, p.pred, c.n1, c.k1, c.u1, c.margin
 FROM rates r JOIN pred p ON r.pool = p.pool AND r.scorer = p.scorer AND r.alpha = p.alpha AND r.n = p.n
 JOIN cells c ON c.pool = r.pool AND c.scorer = r.scorer AND c.alpha = r.alpha)"""


def sweep(t: Tables):
    def build():
        return R.label_complexity(segments(t), list(KEYS), list(NS), DRAWS, list(RATE_ALPHAS), DELTA)

    return t.stored("sweep", build)


@query("d14_label_complexity", f"{LABELS_SQL} SELECT * FROM sweep", "rate false_cert pred u1 margin")
def d14(t):
    return R.label_complexity(segments(t), list(KEYS), list(NS), DRAWS, list(RATE_ALPHAS), DELTA)


@query(
    "d15_margins",
    f"WITH {V.HUGE}, {V.curve_sql('huge', 'score', 'unsafe', ('req',), '[85]')} "
    "SELECT req, n_pool, n_sel AS n1, k_sel AS k1, k_sel / n_sel AS u1, alpha, alpha - k_sel / n_sel AS margin FROM curve, unnest([0.1, 0.25]::DOUBLE[]) a(alpha)",
    "u1 margin",
)
def d15(t):
    return C.margins(V.pool_huge(t), "score", "unsafe", [0.1, 0.25], ["req"])


TARGET = 0.5


@query(
    "d16_n_star",
    f"WITH {BASE}, {CELLS}, {pred_sql('CASE WHEN n_pool < 4000 THEN list_distinct(list_append(range(10, 4001, 10), n_pool)) ELSE range(10, 4001, 10) END', '4000', 'WHERE margin > 0', 'n <= n_pool')} "
    "SELECT c.*, s.n_star FROM cells c LEFT JOIN (SELECT pool, scorer, alpha, min(CASE WHEN pred >= 0.5 THEN n END)::BIGINT AS n_star FROM pred GROUP BY ALL) s USING (pool, scorer, alpha)",
    "u1 margin",
)
def d16(t):
    cells = R.first_cells(segments(t), list(KEYS), list(RATE_ALPHAS))
    return R.n_star(cells, [*KEYS, "alpha"], DELTA, TARGET)


@query(
    "d17_sufficient_budget",
    f"WITH {BASE}, {CELLS} SELECT *, CASE WHEN margin > 0 THEN ceil(2 * (2 * greatest(ln(1 / {DELTA}), ln(2 / (1 - {TARGET}))) / (margin * margin)) / (n1 / n_pool)"
    f" + 2 * ln(2 / (1 - {TARGET})) / ((n1 / n_pool) * (n1 / n_pool)))::BIGINT END AS bound FROM cells",
    "u1 margin",
)
def d17(t):
    return R.with_sufficient_budget(R.first_cells(segments(t), list(KEYS), list(RATE_ALPHAS)), DELTA, TARGET)


@query(
    "d18_first_budget",
    f"{LABELS_SQL} SELECT pool, scorer, alpha, min(CASE WHEN rate >= {TARGET} THEN n END) AS measured_first FROM sweep GROUP BY pool, scorer, alpha",
)
def d18(t):
    return R.first_budget(sweep(t), [*KEYS, "alpha"], TARGET)


@query(
    "d19_prediction_quality",
    f"""{LABELS_SQL}, rk AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS rp,
 rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0::DOUBLE AS rr FROM (SELECT * REPLACE (round(pred, 9) AS pred) FROM sweep))
 SELECT count(*) AS cells, avg(abs(pred - rate)) AS mae, max(false_cert) AS max_false, corr(rp, rr) AS spearman FROM rk""",
    "mae max_false spearman",
)
def d19(t):
    return R.prediction_quality(sweep(t).withColumn("pred", F.round("pred", 9)))


@query(
    "d20_stratum_floor",
    f"WITH {V.POOL}, {DOCS_REQ} SELECT req, min(k_sel / n_sel) AS floor FROM curve GROUP BY req",
    "floor",
)
def d20(t):
    return C.stratum_floor(V.pool(t), "lex4", "unsafe", ["req"])


@query(
    "d21_realised_cutoffs",
    f"WITH {V.POOL}, {CAL}, {chosen_sql('pool', 'lex4', 'doc_id', str(ALPHA), DELTA / 2, ('req',), '')} "
    "SELECT req, min(lex4) AS tau, count(*) AS n FROM chosen GROUP BY ROLLUP (req)",
)
def d21(t):
    kept, _ = C.certified_selection(V.pool(t), _cal(t), "lex4", "unsafe", ALPHA, DELTA, V.IDS, ["req"])
    return C.realised_cutoffs(kept, V.pool(t), V.IDS, "lex4", "req")
