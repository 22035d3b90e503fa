"""Metric, report and audit queries (F, G, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import arms as A
from plumbline.operators import audit as H
from plumbline.operators import certify as C
from plumbline.operators import metrics as M
from plumbline.operators import reports as R
from plumbline.operators.sampling import calibration_draw
from plumbline.plans import views as V
from plumbline.plans.q_arms import META_SQL, SELECTIONS, meta, stored_selections
from plumbline.plans.q_certify import ALPHA, CAL_N, DELTA, scored_pools
from plumbline.plans.q_pool import ANSWERS_SQL, GROUPED, REFUSAL_SQL, answers, grouped
from plumbline.plans.registry import Tables, query


SCORED_SAFE = "scored AS (SELECT 'docs' AS pool, 'lex4' AS scorer, lex4 AS score, NOT unsafe AS safe FROM pool UNION ALL SELECT 'docs', 'lex8', lex8, NOT unsafe FROM pool UNION ALL SELECT 'docs', 'len', len_score, NOT unsafe FROM pool UNION ALL SELECT 'events', 'value', score, NOT unsafe FROM big)"


@query("f01_auroc", f"WITH {V.POOL}, {V.BIG}, {SCORED_SAFE} {V.auroc_sql('scored', 'score', 'safe', 'pool, scorer')}", "auroc")
def f01(t):
    return M.auroc(scored_pools(t).withColumn("safe", ~F.col("unsafe")), "score", "safe", ["pool", "scorer"])


@query("f01_auroc_lineitem", f"WITH {V.HUGE} {V.auroc_sql('huge', 'score', 'unsafe')}", "auroc")
def f01h(t):
    return M.auroc(V.pool_huge(t), "score", "unsafe")


@query(
    "f02_youden_cut",
    f"WITH {V.POOL}, c AS (SELECT s AS cut, (SELECT count(*) FROM pool WHERE unsafe AND lex4 <= s) / (SELECT count(*) FROM pool WHERE unsafe) AS tpr, "
    "(SELECT count(*) FROM pool WHERE NOT unsafe AND lex4 <= s) / (SELECT count(*) FROM pool WHERE NOT unsafe) AS fpr FROM (SELECT DISTINCT lex4 AS s FROM pool)), "
    "b AS (SELECT cut, tpr - fpr AS youden FROM c ORDER BY youden DESC, cut LIMIT 1) "
    "SELECT cut, youden, (SELECT avg((lex4 < cut)::INT) FROM pool WHERE NOT unsafe) AS flag_safe, (SELECT avg((lex4 < cut)::INT) FROM pool WHERE unsafe) AS flag_unsafe FROM b",
    "youden flag_safe flag_unsafe",
)
def f02(t):
    return M.youden_cut(V.pool(t), "lex4", "unsafe")


@query(
    "f03_flag_calibration",
    f"WITH {V.VERDICTS} SELECT judge, avg(CASE WHEN NOT unsafe THEN flag::INT END) AS flag_safe, avg(CASE WHEN unsafe THEN flag::INT END) AS flag_unsafe, avg((flag = unsafe)::INT) AS accuracy FROM verdicts GROUP BY judge",
    "flag_safe flag_unsafe accuracy",
)
def f03(t):
    return M.flag_calibration(V.verdicts(t), "flag", "unsafe", ["judge"])


RATES = "rates AS (SELECT model, arm, seed, judge, avg(flag::INT) AS flag_rate, avg(score) AS mean_score FROM verdicts GROUP BY ALL)"


def rates(t: Tables):
    return M.model_rates(V.verdicts(t), ("model", "arm", "seed", "judge"))


@query("f04_model_rates", f"WITH {V.VERDICTS}, {RATES} SELECT model, judge, flag_rate, mean_score FROM rates", "flag_rate mean_score")
def f04(t):
    return M.model_rates(V.verdicts(t))


CELLS = "cells AS (SELECT arm, judge, avg(flag_rate) AS mean, stddev_samp(flag_rate) / sqrt(count(*)) AS se, count(*) AS n_seeds FROM rates GROUP BY arm, judge)"


@query("f05_arm_mean_se", f"WITH {V.VERDICTS}, {RATES}, {CELLS} SELECT * FROM cells", "mean se")
def f05(t):
    return R.arm_mean_se(rates(t))


# the calibration draws of three seeds as strata of one certificate, for the whole pool and for its parts
SEEDED = (
    "seeded AS (SELECT pool.*, seed FROM pool, unnest([0, 1, 2]) s(seed)), cal AS ("
    + " UNION ALL ".join(f"SELECT * FROM (SELECT *, {x} AS seed FROM pool ORDER BY {V.keyed_sql('cal', x, 'doc_id')} LIMIT {CAL_N})" for x in (0, 1, 2))
    + ")"
)


def _decided_sql(arm: str, delta: float, keys: tuple[str, ...]) -> str:
    return (
        f"SELECT '{arm}' AS arm, seed, bool_and(c) AS certified FROM (WITH {V.curve_sql('seeded', 'lex4', 'unsafe', keys)}, {V.audit_sql('cal', 'lex4', 'unsafe', keys)}, "
        f"tests AS (SELECT *, {V.p_upper_sql('k', 'm', 'n_sel', str(ALPHA))} AS p FROM counts), {V.walk_sql('tests', f'p <= {delta}', keys)} "
        f"SELECT {', '.join(keys)}, bool_or(deployed) AS c FROM audit GROUP BY ALL) GROUP BY seed"
    )


DECISIONS = f"{SEEDED}, decisions AS ({_decided_sql('certified', DELTA, ('seed',))} UNION ALL {_decided_sql('stratified', DELTA / 2, ('seed', 'req'))})"
REPORT_META = (
    f"{DECISIONS}, named AS (SELECT * REPLACE (CASE arm WHEN 'top' THEN 'certified' WHEN 'rejects' THEN 'stratified' ELSE arm END AS arm) FROM meta), "
    "meta2 AS (SELECT arm, seed, bad_frac, demo_share, coalesce(certified, false) AS certified FROM named LEFT JOIN decisions USING (arm, seed))"
)


def decisions(t: Tables):
    """Per certified arm and seed whether its certificate was given: in every stratum, where the arm has strata."""

    def build():
        p = V.pool(t).select("doc_id", "lex4", "unsafe", "req")
        cal = None
        for s in V.SEEDS:
            one = calibration_draw(p, CAL_N, s, V.IDS).withColumn("seed", F.lit(s))
            cal = one if cal is None else cal.unionByName(one)
        out = None
        for arm, delta, strata in (("certified", DELTA, []), ("stratified", DELTA / 2, ["req"])):
            audit = C.certify_draws(p, cal, "seed", list(V.SEEDS), "lex4", "unsafe", ALPHA, delta, strata)
            cuts = C.cutoffs(audit, ["seed", *strata])
            part = cuts.groupBy(F.lit(arm).alias("arm"), "seed").agg(F.min("certified").alias("certified"))
            out = part if out is None else out.unionByName(part)
        return out

    return t.stored("decisions", build)


def report_meta(t: Tables):
    arm = F.when(F.col("arm") == "top", "certified").when(F.col("arm") == "rejects", "stratified").otherwise(F.col("arm"))
    named = meta(t).select(arm.alias("arm"), "seed", "bad_frac", "demo_share")
    return named.join(decisions(t), ["arm", "seed"], "left").withColumn("certified", F.coalesce("certified", F.lit(False)))


_J = ", ".join(f"max(CASE WHEN judge = '{j}' THEN mean END) AS {j}_mean, max(CASE WHEN judge = '{j}' THEN se END) AS {j}_se" for j in V.JUDGES)


@query(
    "f06_condition_report",
    f"WITH {V.POOL}, {V.VERDICTS}, {RATES}, {CELLS}, {SELECTIONS}, {META_SQL}, {REPORT_META}, "
    f"comp AS (SELECT arm, avg(bad_frac) AS bad_frac, avg(demo_share) AS demo_share, sum(certified::INT)::BIGINT AS n_certified, count(*) AS n_seeds FROM meta2 GROUP BY arm), "
    f"j AS (SELECT arm, {_J} FROM cells GROUP BY arm) SELECT * FROM comp LEFT JOIN j USING (arm)",
    "bad_frac demo_share " + " ".join(f"{j}_mean {j}_se" for j in V.JUDGES),
)
def f06(t):
    return R.condition_report(report_meta(t), rates(t), list(V.JUDGES))


@query(
    "f07_over_refusal",
    "WITH p AS (SELECT event_type, user_id % 10 AS model, CASE WHEN event_type = 'error' THEN 'unsafe' ELSE 'safe' END AS label, value > 20 AS refusal, value < 5 AS harmful FROM events) "
    "SELECT model, avg(CASE WHEN label = 'safe' THEN refusal::INT END) AS safe_refusal, avg(CASE WHEN label = 'unsafe' THEN harmful::INT END) AS unsafe_harmful, "
    "avg(CASE WHEN label = 'unsafe' THEN refusal::INT END) AS unsafe_refusal FROM p GROUP BY model",
    "safe_refusal unsafe_harmful unsafe_refusal",
)
def f07(t):
    p = t.events.select(
        (F.col("user_id") % 10).alias("model"),
        F.when(F.col("event_type") == "error", "unsafe").otherwise("safe").alias("label"),
        (F.col("value") > 20).alias("refusal"),
        (F.col("value") < 5).alias("harmful"),
    )
    return M.over_refusal(p, "label", "refusal", "harmful", ["model"])


# each match of a token is one position, descending within a token, so the longest increasing run of positions is the longest common
# subsequence; the fold keeps the least last position of a run of each length
PILES = "list_filter(acc, lambda p: p < e[1])"
LCS_SQL = (
    "len(list_reduce(list_prepend([]::BIGINT[], list_transform(flatten(list_transform(b, lambda y: list_reverse_sort(list_filter(range(1, len(a) + 1), lambda i: a[i] = y)))), lambda x: [x])), "
    f"lambda acc, e: acc[1:len({PILES})] || e || acc[len({PILES}) + 2:]))"
)
TOKENS = "list_filter(string_split_regex(lower(coalesce({}, '')), '\\s+'), lambda x: x <> '')"


@query(
    "f08_rouge_l",
    f"""WITH {V.QA}, g AS (SELECT conv_id, turn, unnest(['answer', 'echo']) AS model, unnest([response, prompt]) AS hyp FROM qa),
 r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nr, response FROM qa),
 p AS (SELECT model, g.conv_id, g.turn, {TOKENS.format('hyp')} AS a, {TOKENS.format('later.response')} AS b
  FROM g JOIN r AS own ON own.conv_id = g.conv_id AND own.turn = g.turn JOIN r AS later ON later.conv_id = g.conv_id AND later.nr IN (own.nr + 1, own.nr + 2)),
 s AS (SELECT *, {LCS_SQL} AS c FROM p),
 best AS (SELECT model, conv_id, turn, max(CASE WHEN c > 0 THEN 2 * c / (len(a) + len(b)) ELSE 0.0 END) AS f FROM s GROUP BY ALL)
 SELECT model, avg(f) AS rouge_l, count(*) AS n_prompts FROM best GROUP BY model""",
    "rouge_l",
)
def f08(t):
    """Every exchange's answer, and its question, against the answers of the next two exchanges of the conversation; whole texts."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    qa = V.qa_pairs(t)
    # only ids and turns are numbered, so a long conversation's texts stay where they are
    turns = qa.select("conv_id", "turn").select("*", *[F.lag("turn", k).over(order).alias(f"_{k}") for k in (1, 2)])
    earlier = turns.select("conv_id", "turn", F.explode(F.array("_1", "_2")).alias("of")).where("of is not null")
    key = lambda turn: F.concat_ws(":", "conv_id", turn).alias("exchange")
    sides = F.array(
        F.struct(F.lit("answer").alias("model"), "response"), F.struct(F.lit("echo").alias("model"), F.col("prompt").alias("response"))
    )
    gens = qa.select(key("turn"), F.inline(sides)).withColumn("item", F.col("exchange"))
    refs = qa.join(earlier, ["conv_id", "turn"]).select(key("of"), "response")
    return M.rouge_l(gens, refs, "exchange", ["model"], "item")


@query(
    "f09_preference_rate",
    "WITH p AS (SELECT l_returnflag AS arm, l_discount AS a, l_tax AS b FROM lineitem) SELECT arm, avg((a > b)::INT) AS preference_rate, count(*) AS n_pairs FROM p GROUP BY arm",
    "preference_rate",
)
def f09(t):
    p = t.lineitem.select(F.col("l_returnflag").alias("arm"), "l_discount", "l_tax")
    return M.preference_rate(p, "l_discount", "l_tax", ["arm"])


ITEM = ["model", "item_no"]


@query(
    "f10_judge_agreement",
    f"WITH {V.VERDICTS}, p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n, avg((a.flag = b.flag)::INT) AS agreement, avg(a.flag::INT) AS pa, avg(b.flag::INT) AS pb "
    "FROM verdicts a JOIN verdicts b ON a.model = b.model AND a.item_no = b.item_no AND a.judge < b.judge GROUP BY ALL), "
    "e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM p) SELECT judge_a, judge_b, n, agreement, CASE WHEN pe < 1 THEN (agreement - pe) / (1 - pe) END AS kappa FROM e",
    "agreement kappa",
)
def f10(t):
    return M.judge_agreement(V.verdicts(t), ITEM, list(V.JUDGES))


@query(
    "f11_all_agree",
    f"WITH {V.VERDICTS}, i AS (SELECT model, item_no, min(flag::INT) = max(flag::INT) AS same FROM verdicts GROUP BY ALL) SELECT count(*) AS n_items, avg(same::INT) AS all_agree FROM i",
    "all_agree",
)
def f11(t):
    return M.all_agree(V.verdicts(t), ITEM)


@query("f11_judge_flag_rates", f"WITH {V.VERDICTS} SELECT judge, avg(flag::INT) AS flag_rate, count(*) AS n FROM verdicts GROUP BY judge", "flag_rate")
def f11r(t):
    return M.judge_flag_rates(V.verdicts(t))


def spearman_sql(src: str, x: str, y: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    avg_rank = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}{c}) - 1) / 2"
    return f"SELECT {k}corr(rx, ry) AS spearman, count(*) AS n FROM (SELECT {k}{avg_rank(x)} AS rx, {avg_rank(y)} AS ry FROM {src}) {g}"


def conditions(t: Tables):
    """Flags and refusals of every condition (source, arm) under each judge."""
    v = V.verdicts(t, V.pool(t).select(F.col("doc_id").alias("item_no"), "source", "lex8"))
    return v.groupBy("judge", "source", "arm").agg(
        F.count_if("flag").alias("x"), F.count_if("refusal").alias("y")
    )


CONDITIONS = "conditions AS (SELECT judge, source, arm, sum(flag::INT)::BIGINT AS x, sum(refusal::INT)::BIGINT AS y FROM verdicts JOIN pool ON doc_id = item_no GROUP BY ALL)"


@query("f12_spearman", f"WITH {V.POOL}, {V.VERDICTS}, {CONDITIONS} {spearman_sql('conditions', 'x', 'y', 'judge')}", "spearman")
def f12(t):
    return M.spearman(conditions(t), "x", "y", ["judge"])


@query("f12_spearman_lineitem", f"WITH big AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem) {spearman_sql('big', 'x', 'y')}", "spearman")
def f12h(t):
    return M.spearman(t.lineitem, "l_quantity", "l_extendedprice", [])


TRANSFER = f"""per AS (SELECT judge, set, spearman FROM (SELECT judge, arm AS set, corr(rx, ry) AS spearman FROM (
 SELECT judge, arm, rank() OVER (PARTITION BY judge, arm ORDER BY x) + (count(*) OVER (PARTITION BY judge, arm, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY judge, arm ORDER BY y) + (count(*) OVER (PARTITION BY judge, arm, y) - 1) / 2 AS ry FROM conditions) GROUP BY judge, arm))"""


@query(
    "f13_transfer_summary",
    f"WITH {V.POOL}, {V.VERDICTS}, {CONDITIONS}, {TRANSFER} SELECT min(spearman) AS clean_min, max(spearman) AS clean_max, sum((spearman < 0.9)::INT)::BIGINT AS n_below, count(*) AS n_pairs, "
    "min(CASE WHEN set = 'full' THEN spearman END) AS pooled_min, max(CASE WHEN set = 'full' THEN spearman END) AS pooled_max FROM per WHERE judge <> 'j4'",
    "clean_min clean_max pooled_min pooled_max",
)
def f13(t):
    per = M.spearman(conditions(t), "x", "y", ["judge", "arm"]).withColumnRenamed("arm", "set")
    return M.transfer_summary(per, ["j1", "j2", "j3"], pooled="full")


def harm_verdicts(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("item_no"), F.col("lang").alias("set"), F.col("source").alias("category"))
    return V.verdicts(t, d)


@query(
    "f14_harmset_rates",
    f"WITH {V.VERDICTS}, h AS (SELECT v.*, d.lang AS set, d.source AS category FROM verdicts v JOIN documents d ON d.doc_id = v.item_no) "
    "SELECT model, judge, set, category, avg(flag::INT) AS flag_rate, count(*) AS n FROM h GROUP BY GROUPING SETS ((model, judge), (model, judge, set), (model, judge, set, category))",
    "flag_rate",
)
def f14(t):
    return M.harmset_rates(harm_verdicts(t))


CATS = "cats AS (SELECT doc_id AS item_no, unnest(list_distinct([lang, source] || CASE WHEN n_chars > 2000 THEN ['long'] ELSE [] END)) AS category FROM documents JOIN labels USING (doc_id))"


@query(
    "f15_category_rates",
    f"WITH {V.VERDICTS}, {CATS}, ok AS (SELECT category, count(DISTINCT item_no) AS n_prompts FROM cats GROUP BY category HAVING count(DISTINCT item_no) >= 10), "
    "m AS (SELECT arm, seed, category, avg(flag::INT) AS r FROM (SELECT * REPLACE (arm || ':' || judge AS arm) FROM verdicts) JOIN cats USING (item_no) GROUP BY ALL) "
    "SELECT arm, category, avg(r) AS flag_rate, n_prompts FROM m JOIN ok USING (category) GROUP BY ALL",
    "flag_rate",
)
def f15(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id"), "doc_id")
    cats = d.select(
        F.col("doc_id").alias("item_no"),
        F.array_compact(F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long"))).alias("categories"),
    )
    panel = V.verdicts(t).withColumn("arm", F.concat_ws(":", "arm", "judge"))
    return M.category_rates(panel, cats, "item_no")


PROBS = "probs AS (SELECT vec_id, label, list_transform(embedding, lambda x: (CASE WHEN x > 0 THEN x::DOUBLE * 4 ELSE 0.0::DOUBLE END)) AS p FROM embeddings)"
CAT_NAMES = [f"c{i:02d}" for i in range(1, 65)]


def _probs(t: Tables):
    p = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double") * 4).otherwise(F.lit(0.0)))
    return t.embeddings.select("vec_id", "label", p.alias("p"))


@query(
    "f16_category_probs",
    f"WITH {PROBS}, e AS (SELECT unnest(p) AS x, unnest(range(1, 65)) AS i FROM probs) SELECT 'c' || lpad(i::VARCHAR, 2, '0') AS category, avg((x > 0.5)::INT) AS flag_rate, avg(x) AS mean_prob, count(*) AS n FROM e GROUP BY i",
    "flag_rate mean_prob",
)
def f16(t):
    return M.category_probs(_probs(t), "p", CAT_NAMES)


@query("f16_any_category", f"WITH {PROBS} SELECT label, avg((list_max(p) > 0.5)::INT) AS any_flag_rate FROM probs GROUP BY label", "any_flag_rate")
def f16a(t):
    return M.any_category_rate(_probs(t), "p", by=["label"])


SELF = [("certified", "j4"), ("stratified", "j4")]


def marked(t: Tables):
    return R.mark_self_scored(R.arm_mean_se(rates(t)), t.spark.createDataFrame(SELF, "arm string, judge string"))


MARKED = "marked AS (SELECT *, (arm IN ('certified', 'stratified') AND judge = 'j4') AS self_scored FROM cells)"


@query(
    "f17_best_per_column",
    f"WITH {V.VERDICTS}, {RATES}, {CELLS}, {MARKED} SELECT judge, arm, mean FROM (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY mean, arm) AS rn FROM marked WHERE arm NOT IN ('oracle', 'base') AND NOT self_scored) WHERE rn = 1",
    "mean",
)
def f17(t):
    return R.best_per_column(marked(t), ["oracle", "base"])


@query("f18_mark_self_scored", f"WITH {V.VERDICTS}, {RATES}, {CELLS}, {MARKED} SELECT * FROM marked", "mean se")
def f18(t):
    return marked(t)


@query(
    "f19_tension",
    f"""WITH {V.POOL}, {SELECTIONS}, k AS (SELECT g.arm, g.seed, p.*, s.doc_id IS NOT NULL AS kept FROM pool p CROSS JOIN (SELECT DISTINCT arm, seed FROM selections) g
 LEFT JOIN selections s ON s.arm = g.arm AND s.seed = g.seed AND s.doc_id = p.doc_id),
 c AS (SELECT arm, seed, count(*)::DOUBLE AS n, sum(unsafe::INT)::DOUBLE AS u, sum((NOT unsafe AND req)::INT)::DOUBLE AS s1, sum((NOT unsafe AND NOT req)::INT)::DOUBLE AS s0,
 sum((kept AND unsafe)::INT)::DOUBLE AS ku, sum((kept AND NOT unsafe AND req)::INT)::DOUBLE AS k1, sum((kept AND NOT unsafe AND NOT req)::INT)::DOUBLE AS k0 FROM k GROUP BY arm, seed)
 SELECT arm, seed, ku / u AS r_u, k1 / s1 AS r_1, k0 / s0 AS r_0, CASE WHEN ku > 0 THEN (k1 / s1) / (ku / u) END AS c, CASE WHEN k1 + k0 > 0 THEN k1 / (k1 + k0) END AS pi_kept,
 CASE WHEN ku > 0 THEN (k1 / s1) / (ku / u) * (s1 / (s1 + s0)) * (0.1::DOUBLE / 0.9::DOUBLE) * (1 - u / n) / (u / n) END AS bound, ku / (ku + k1 + k0) AS bad_kept FROM c""",
    "r_u r_1 r_0 c pi_kept bound bad_kept",
)
def f19(t):
    sel = stored_selections(t)
    p = V.pool(t).select("doc_id", "unsafe", "req")
    # kept rows by a join; what an arm left out is the pool's count minus the arm's
    return M.tension(sel.join(p, "doc_id"), p, ["arm", "seed"], "unsafe", "req", 0.1)


DOSED = "dosed AS (SELECT judge, seed, arm, CASE arm WHEN 'labels' THEN 0.1::DOUBLE WHEN 'certified' THEN 0.25::DOUBLE WHEN 'stratified' THEN 0.4::DOUBLE WHEN 'full' THEN 1.0::DOUBLE ELSE 0.54::DOUBLE END AS dose, flag_rate FROM rates)"


def dosed(t: Tables):
    dose = F.when(F.col("arm") == "labels", 0.1).when(F.col("arm") == "certified", 0.25).when(F.col("arm") == "stratified", 0.4)
    return rates(t).withColumn("dose", dose.when(F.col("arm") == "full", 1.0).otherwise(0.54))


@query(
    "f20_dose_slope",
    f"WITH {V.VERDICTS}, {RATES}, {DOSED}, s AS ({spearman_sql('dosed', 'dose', 'flag_rate', 'judge')}), "
    "l AS (SELECT judge, regr_slope(flag_rate, dose) AS slope, regr_intercept(flag_rate, dose) AS intercept FROM dosed GROUP BY judge) SELECT judge, slope, intercept, spearman FROM l JOIN s USING (judge)",
    "slope intercept spearman",
)
def f20(t):
    return M.dose_slope(dosed(t), "dose", "flag_rate", ["judge"])


@query("f21_group_means", f"WITH {V.POOL}, g AS (SELECT *, {GROUPED} FROM pool) SELECT \"group\", avg(lex4) AS mean_score, count(*) AS n FROM g GROUP BY \"group\"", "mean_score")
def f21(t):
    return M.group_means(grouped(t), "group", "lex4")


@query(
    "f22_detector_agreement",
    f"WITH {V.QA}, {ANSWERS_SQL}, d AS (SELECT {REFUSAL_SQL} AS rx, length(response) < 400 AS learned FROM answers) SELECT avg(learned::INT) AS learned_rate, avg(rx::INT) AS regex_rate, avg((rx = learned)::INT) AS agreement FROM d",
    "learned_rate regex_rate agreement",
)
def f22(t):
    d = answers(t).select(T.is_refusal("response").alias("rx"), (F.length("response") < 400).alias("learned"))
    return M.detector_agreement(d, "learned", "rx")


@query(
    "f23_arm_refusal_share",
    f"WITH {V.POOL}, {SELECTIONS}, s AS (SELECT arm, seed, count(*) AS n, avg(unsafe::INT) AS b, avg(CASE WHEN NOT unsafe THEN (n_chars % 2 = 0)::INT END) AS r FROM selections JOIN pool USING (doc_id) GROUP BY ALL) "
    "SELECT arm, avg(n) AS mean_n, avg(b) AS bad_frac, avg(r) AS refusal_share FROM s GROUP BY arm",
    "mean_n bad_frac refusal_share",
)
def f23(t):
    p = V.pool(t).select("doc_id", "unsafe", (F.col("n_chars") % 2 == 0).alias("refusal"))
    return M.arm_refusal_share(stored_selections(t).join(p, "doc_id"), "unsafe", "refusal")


@query(
    "f24_group_histogram",
    f"WITH {V.POOL}, g AS (SELECT *, {GROUPED} FROM pool), s AS (SELECT min(lex4) AS lo, (max(lex4) - min(lex4)) / 39 AS w FROM pool), "
    "b AS (SELECT \"group\", least(38, floor((lex4 - lo) / w))::INT AS bin, lo, w, count(*) AS n FROM g, s GROUP BY ALL) "
    "SELECT \"group\", bin, lo + bin * w AS left_edge, n, n / (sum(n) OVER (PARTITION BY \"group\") * w) AS density FROM b",
    "left_edge density",
)
def f24(t):
    return M.group_histogram(grouped(t), "group", "lex4")


@query(
    "f25_group_kde",
    f"WITH {V.POOL}, g AS (SELECT *, {GROUPED} FROM pool), x AS (SELECT i::INT AS point, -1000 + i * 20.0::DOUBLE AS x FROM range(0, 51) t(i)) "
    "SELECT \"group\", point, x, sum(exp(-0.5 * pow((x - lex4) / 25.0, 2))) / (count(*) * 25.0) AS density FROM g, x GROUP BY ALL",
    "density",
)
def f25(t):
    return M.group_kde(grouped(t), "group", "lex4", [-1000 + i * 20.0 for i in range(51)], 25.0)


RHOS = ("low", "mid", "high")
RHO_SQL = "CASE WHEN seed = 0 THEN 'low' WHEN seed = 1 THEN 'mid' ELSE 'high' END AS rho"


@query(
    "f26_lambda_sweep",
    f"WITH {V.POOL}, {V.VERDICTS}, {RATES}, {SELECTIONS}, {META_SQL}, {REPORT_META}, r AS (SELECT *, {RHO_SQL} FROM rates), m AS (SELECT *, {RHO_SQL} FROM meta2), "
    "a AS (SELECT arm, judge, " + ", ".join(f"avg(CASE WHEN rho = '{x}' THEN flag_rate END) AS mean_{x}" for x in RHOS) + " FROM r GROUP BY arm, judge), "
    "b AS (SELECT arm, " + ", ".join(f"sum(CASE WHEN rho = '{x}' THEN certified::INT END)::BIGINT AS certified_{x}" for x in RHOS) + " FROM m GROUP BY arm) SELECT * FROM a LEFT JOIN b USING (arm)",
    " ".join(f"mean_{x}" for x in RHOS),
)
def f26(t):
    rho = F.when(F.col("seed") == 0, "low").when(F.col("seed") == 1, "mid").otherwise("high")
    return R.lambda_sweep(rates(t).withColumn("rho", rho), report_meta(t).withColumn("rho", rho), list(RHOS), by=("judge",))


@query(
    "f27_dose_table",
    f"WITH {V.VERDICTS}, {RATES}, {DOSED} SELECT dose, judge, avg(flag_rate) AS mean, stddev_samp(flag_rate) / sqrt(count(*)) AS se, count(*) AS n_seeds FROM dosed GROUP BY dose, judge",
    "mean se",
)
def f27(t):
    named = dosed(t).withColumn("arm", F.concat(F.lit("dose"), F.col("dose").cast("string")))
    return R.dose_table(named, "dose")


@query("f28_demo_share_good", f"WITH {V.POOL}, {SELECTIONS}, {META_SQL} SELECT arm, avg(demo_share) / (1 - avg(bad_frac)) AS demo_share_good FROM meta GROUP BY arm", "demo_share_good")
def f28(t):
    return M.demo_share_good(meta(t))


@query(
    "f29_composition_bin",
    f"WITH {V.POOL}, {SELECTIONS}, {META_SQL} SELECT arm, seed, CASE WHEN bad_frac <= 0.1 THEN '<=.10' WHEN bad_frac <= 0.25 THEN '.10-.25' ELSE '>.25' END AS bin FROM meta",
)
def f29(t):
    return meta(t).select("arm", "seed", M.composition_bin().alias("bin"))


@query(
    "f30_removed_share",
    f"WITH {V.POOL}, {SELECTIONS}, {META_SQL}, p AS (SELECT count(*) AS np, avg(unsafe::INT) AS rho FROM pool) "
    "SELECT arm, seed, 1 - (n - bad_frac * n) / (np * (1 - rho)) AS removed_good, 1 - bad_frac * n / (np * rho) AS removed_bad FROM meta, p",
    "removed_good removed_bad",
)
def f30(t):
    size = V.pool(t).agg(F.count(F.lit(1)).alias("np"), M.share("unsafe").alias("rho")).first()
    return M.removed_share(meta(t), F.lit(size["np"]), F.lit(size["rho"]))


@query("f31_generation_refusal", f"WITH {V.QA}, {ANSWERS_SQL} SELECT conv_id % 3 AS model, avg({REFUSAL_SQL}::INT) AS refusal_rate, count(*) AS n FROM answers GROUP BY ALL", "refusal_rate")
def f31(t):
    return M.generation_refusal(answers(t).withColumn("model", F.col("conv_id") % 3))


DECILES = f"dec AS (SELECT doc_id, unsafe, demo, (ntile(10) OVER (ORDER BY lex4 DESC, {V.tie_sql('doc_id')}) - 1)::INT AS decile FROM pool)"


@query(
    "f32_decile_profile",
    f"WITH {V.POOL}, {V.VERDICTS}, {DECILES}, c AS (SELECT decile, count(*) AS n, avg(unsafe::INT) AS bad_frac, avg(demo::INT) AS demo_share FROM dec GROUP BY decile), "
    "s AS (SELECT decile, arm, judge, seed, avg(flag::INT) AS r FROM dec JOIN verdicts ON item_no = doc_id GROUP BY ALL), "
    "j AS (SELECT decile, arm, judge, avg(r) AS mean, stddev_samp(r) / sqrt(count(*)) AS se, count(*) AS n_seeds FROM s GROUP BY ALL) SELECT * FROM c JOIN j USING (decile)",
    "bad_frac demo_share mean se",
)
def f32(t):
    dec = A.with_decile(V.pool(t), "lex4", V.IDS).select("doc_id", "unsafe", "demo", "decile")
    v = V.verdicts(t).withColumnRenamed("item_no", "doc_id").select("doc_id", "arm", "judge", "seed", "flag")
    return R.decile_profile(dec, "unsafe", "demo", v, V.IDS, by=("arm",))


# ---- lookups and audits


@query(
    "g01_first_contrast",
    f"""WITH {V.VERDICTS}, c AS (SELECT item_no FROM verdicts WHERE judge IN ('j1', 'j2') AND model IN ('full_s0', 'certified_s0') GROUP BY item_no
 HAVING sum((model = 'full_s0' AND flag)::INT) = 2 AND sum((model = 'certified_s0')::INT) = 2 AND sum((model = 'certified_s0' AND flag)::INT) = 0),
 d AS (SELECT doc_id, text, source FROM documents WHERE length(text) <= 3000 AND NOT contains(lower(text), 'moron') AND NOT contains(lower(text), 'loser'))
 SELECT doc_id AS item_no, source AS prompt FROM c JOIN d ON doc_id = item_no ORDER BY doc_id LIMIT 1""",
)
def g01(t):
    gens = t.documents.select(F.col("doc_id").alias("item_no"), F.col("text").alias("response"))
    prompts = t.documents.select(F.col("doc_id").alias("item_no"), F.col("source").alias("prompt"))
    return H.first_contrast(V.verdicts(t), gens, "full_s0", "certified_s0", ["j1", "j2"], 3000, ("moron", "loser"), prompts)


@query(
    "g02_representatives",
    f"WITH {V.POOL}, g AS (SELECT *, {GROUPED} FROM pool), m AS (SELECT \"group\", quantile_cont(lex4, 0.5) AS median FROM g GROUP BY \"group\"), "
    "r AS (SELECT g.\"group\", doc_id, lex4, median, row_number() OVER (PARTITION BY g.\"group\" ORDER BY abs(lex4 - median), doc_id) AS rn FROM g JOIN m ON g.\"group\" = m.\"group\" WHERE n_chars <= 1500) "
    "SELECT \"group\", doc_id, lex4, median FROM r WHERE rn = 1",
)
def g02(t):
    return H.representatives(grouped(t), "group", "lex4", F.col("n_chars") <= 1500, V.IDS)


REQUIRED = [("full", "j1", 3), ("oracle", "j2", 3), ("labels", "j3", 4), ("missing", "j1", 1)]


@query(
    "h01_coverage",
    f"WITH {V.VERDICTS}, req(arm, judge, min_seeds) AS (VALUES ('full', 'j1', 3), ('oracle', 'j2', 3), ('labels', 'j3', 4), ('missing', 'j1', 1)), "
    "h AS (SELECT arm, judge, count(DISTINCT seed) AS n FROM verdicts GROUP BY ALL) "
    "SELECT arm, judge, min_seeds, coalesce(n, 0) AS n_seeds, CASE WHEN coalesce(n, 0) >= min_seeds THEN 'PASS' ELSE 'FAIL' END AS status FROM req LEFT JOIN h USING (arm, judge)",
)
def h01(t):
    req = t.spark.createDataFrame(REQUIRED, "arm string, judge string, min_seeds int")
    return H.coverage(req, V.verdicts(t), ["arm", "judge"])


@query(
    "h02_expectations",
    f"WITH {V.VERDICTS}, {RATES} SELECT model, judge, flag_rate AS actual, round(mean_score, 2) AS claimed, 0.01::DOUBLE AS tolerance, abs(round(mean_score, 2) - flag_rate) <= 0.01::DOUBLE AS ok FROM rates",
    "actual claimed",
)
def h02(t):
    r = M.model_rates(V.verdicts(t))
    return H.expectations(
        r.select("model", "judge", F.col("flag_rate").alias("actual"), F.round("mean_score", 2).alias("claimed"), F.lit(0.01).alias("tolerance"))
    )


@query(
    "h02_list_expectations",
    f"WITH {V.VERDICTS}, {RATES}, l AS (SELECT arm, judge, list(flag_rate ORDER BY seed) AS a FROM rates GROUP BY ALL) "
    "SELECT arm, judge, judge <> 'j4' AND list_bool_and(list_transform(a, lambda x: abs(x - 0.35::DOUBLE) <= 0.02::DOUBLE)) AS ok FROM l",
)
def h02l(t):
    lists = rates(t).groupBy("arm", "judge").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seed", "flag_rate"))), lambda s: s["flag_rate"]).alias("actual")
    )
    claimed = F.when(F.col("judge") == "j4", F.array(F.lit(0.35))).otherwise(F.array_repeat(F.lit(0.35), 3))
    return H.list_expectations(lists.withColumn("claimed", claimed).withColumn("tolerance", F.lit(0.02))).select("arm", "judge", "ok")


def nested_json(t: Tables):
    """Per event a document around its stored properties: five levels deep, now and then a list of 70 numbers, and every 11th text cut short."""
    many = F.when(F.col("event_id") % 50 == 0, 69).otherwise(0)
    j = F.concat(
        F.lit('{"props": '), F.col("props"), F.lit(', "user": {"id": '), F.col("user_id").cast("string"),
        F.lit(', "ok": true, "name": "x1 [{"}, "list": [1.5, [2, null, {"deep": {"er": -3}}], "3"], "many": ['),
        F.array_join(F.transform(F.sequence(F.lit(0), many), lambda i: (F.col("user_id") + i).cast("string")), ","), F.lit("]}"),
    )
    return t.events.select("event_id", F.when(F.col("event_id") % 11 == 0, F.substring(j, 1, 30)).otherwise(j).alias("json"))


@query(
    "h03_flatten_json",
    "WITH fit AS (SELECT * FROM events WHERE event_id % 11 <> 0) "
    "SELECT event_id AS file, unnest(['/props/k', '/user/id', '/list[0]', '/list[1][0]', '/list[1][2]/deep/er']) AS path, "
    "unnest([(props::JSON ->> '$.k')::DOUBLE, user_id::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE, -3.0::DOUBLE]) AS value FROM fit "
    "UNION ALL SELECT event_id, '/many[' || i || ']', (user_id + i)::DOUBLE FROM fit, range(0, 60) r(i) WHERE i = 0 OR event_id % 50 = 0",
)
def h03(t):
    return H.flatten_json(nested_json(t), "event_id", "json", list_limit=60)


@query("h03_malformed_json", "SELECT event_id AS file, 'not JSON' AS error FROM events WHERE event_id % 11 = 0")
def h03m(t):
    return H.malformed_json(nested_json(t), "event_id", "json")


# doubling every separator lets a plain pattern consume one on each side of a number
NUM_SQL = "regexp_extract_all(regexp_replace(text, '([^\\w.\\-%])', '\\1\\1', 'g'), '(?:^|[^\\w.\\-])(\\d+\\.\\d+|\\d{2,})(?:$|[^\\w.%])', 1)"


@query("h04_extract_numbers", f"SELECT doc_id, unnest({NUM_SQL}) AS literal FROM documents")
def h04(t):
    return H.extract_numbers(t.documents, ["doc_id"], "text", False).select("doc_id", "literal")


# the doubled text with a mark on each side of every number; a piece of it has whole pairs of separators only
MARKED_SQL = "regexp_replace(regexp_replace(text, '([^\\w.\\-%])', '\\1\\1', 'g'), '(^|[^\\w.\\-])(\\d+\\.\\d+|\\d{2,})($|[^\\w.%])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
SETTINGS_SQL = ", ".join(f"'{x}'" for x in H.KNOWN_SETTINGS)


@query(
    "h04_extract_numbers_in_context",
    rf"""WITH m AS (SELECT doc_id, text, string_split({MARKED_SQL}, chr(1)) AS p FROM documents),
 l AS (SELECT doc_id, text, p, list_transform(p, lambda x: length(regexp_replace(replace(x, chr(2), ''), '([^\w.\-%])[^\w.\-%]', '\1', 'g'))) AS n FROM m),
 e AS (SELECT doc_id, text, p, n, unnest(range(2, len(p) + 1)) AS i FROM l),
 c AS (SELECT doc_id, text, list_sum(n[1:i - 1])::INT AS pos, string_split(p[i], chr(2))[1] AS literal FROM e)
 SELECT doc_id, pos, literal FROM c WHERE literal NOT IN ({SETTINGS_SQL}) AND NOT (NOT contains(literal, '.') AND literal::DOUBLE > 1900 AND literal::DOUBLE < 2100)
 AND NOT regexp_matches(substr(text, greatest(0, pos - 60) + 1, pos + length(literal) + 30 - greatest(0, pos - 60)), '{H.PROTOCOL_PATTERN}')""",
)
def h04c(t):
    return H.extract_numbers(t.documents, ["doc_id"], "text")


@query(
    "h05_trace",
    f"WITH lit AS (SELECT unnest({NUM_SQL}) AS literal FROM documents), l AS (SELECT literal, count(*) AS n_uses, literal::DOUBLE AS x, "
    "CASE WHEN contains(literal, '.') THEN length(literal) - instr(literal, '.') ELSE 0 END AS k FROM lit GROUP BY literal), "
    "v AS (SELECT n_chars::DOUBLE AS value, count(*) AS n_values FROM documents GROUP BY n_chars) "
    "SELECT literal, n_uses, value, n_values FROM l LEFT JOIN v ON value = x OR (value * 100 = x AND x <= 100)",
)
def h05(t):
    lits = H.extract_numbers(t.documents, ["doc_id"], "text", False)
    return H.trace(lits, t.documents.select(F.col("n_chars").cast("double").alias("value")))


@query(
    "h05_trace_scoped",
    f"""WITH d AS (SELECT doc_id, n_chars::DOUBLE AS value, coalesce(lang, '') AS lang, CASE WHEN lang IN ('en', 'de') THEN [lang] ELSE []::VARCHAR[] END AS names, text FROM documents),
 v AS (SELECT DISTINCT lang, value FROM d), l AS (SELECT doc_id, names, unnest({NUM_SQL}) AS literal FROM d),
 k AS (SELECT DISTINCT names, literal FROM l),
 o AS (SELECT names, literal, max((len(names) = 0 OR list_contains(names, lang))::INT) AS own FROM k JOIN v
  ON value = literal::DOUBLE OR (value * 100 = literal::DOUBLE AND literal::DOUBLE <= 100) GROUP BY ALL)
 SELECT doc_id, literal, names, CASE WHEN own = 1 THEN 'matched' WHEN own = 0 THEN 'exists elsewhere' ELSE 'orphan' END AS outcome
 FROM l LEFT JOIN o USING (names, literal)""",
)
def h05s(t):
    """Numbers of texts against lengths of documents: of the language that the sentence names, elsewhere, or nowhere."""
    docs = t.documents.withColumn("sentence", F.concat(F.lit("lang="), F.coalesce("lang", F.lit("?")), F.lit(";")))
    found = H.extract_numbers(docs, ["doc_id", "sentence"], "text", False)
    values = t.documents.select(F.concat_ws("_", "lang", "source").alias("key"), F.col("n_chars").cast("double").alias("value"))
    scoped = H.trace_scoped(found, ["doc_id"], "sentence", values, "key", "value", {"lang=en;": ["en"], "lang=de;": ["de"]})
    return scoped.withColumn("names", F.transform("names", lambda n: F.substring(n, 6, 2)))


@query(
    "h06_value_conflicts",
    f"WITH {V.VERDICTS}, v AS (SELECT arm, judge, round(mean_score, 3) AS value FROM (SELECT arm, seed, judge, avg(score) AS mean_score FROM verdicts GROUP BY ALL)), "
    "u AS (SELECT arm, judge, value, count(*) AS n_uses FROM v GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY arm, judge) AS n_values FROM u QUALIFY n_values > 1",
)
def h06(t):
    return H.value_conflicts(rates(t).select("arm", "judge", F.round("mean_score", 3).alias("value")), ["arm", "judge"], "value")


SENT = "SELECT doc_id, unnest(string_split(regexp_replace(text, '([.;])\\s+([A-Z(])', '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS s FROM documents"


@query("h07_sentences", f"SELECT doc_id, trim(s) AS sentence FROM ({SENT}) WHERE regexp_matches(s, '\\d')")
def h07(t):
    return H.sentences(t.documents, ["doc_id"], "text").select("doc_id", "sentence")


@query(
    "h07_count_phrases",
    "SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)\\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|all|none|\\d+) (?:of|in) (?:the |its |every )?(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|all|none|\\d+)\\b[^.;]*|\\b\\d/\\d\\b[^.;]*')) AS phrase "
    "FROM (SELECT conv_id, turn, turn + 1 || ' of the ' || conv_id % 7 || ' turns, ' || text AS text FROM conversations)",
)
def h07c(t):
    counted = F.concat(
        (F.col("turn") + 1).cast("string"), F.lit(" of the "), (F.col("conv_id") % 7).cast("string"), F.lit(" turns, "), F.col("text")
    )
    return H.count_phrases(t.conversations.withColumn("text", counted), ["conv_id", "turn"], "text")


@query(
    "h08_snapshot_equal",
    "WITH a AS (SELECT lang, source FROM documents), b AS (SELECT lang, source FROM documents WHERE n_chars > 100) "
    "SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right, "
    "(SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS equal",
)
def h08(t):
    d = t.documents
    return H.snapshot_equal(d.select("lang", "source"), d.where("n_chars > 100").select("lang", "source"))
