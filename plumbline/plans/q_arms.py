"""Selection-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import arms as A
from plumbline.operators.sampling import calibration_draw
from plumbline.plans import views as V
from plumbline.plans.registry import Tables, query
from plumbline.plans.q_certify import CAL, CAL_N

TIE = V.tie_sql("doc_id")


def _top(src: str, score: str, k: str, where: str = "", desc: bool = True) -> str:
    return f"SELECT * FROM {src} {where} ORDER BY {score} {'DESC' if desc else ''}, {TIE} LIMIT {k}"


@query("e01_select_all", f"WITH {V.POOL} SELECT doc_id FROM pool")
def e01(t):
    return A.select_all(V.pool(t)).select("doc_id")


@query("e01_select_oracle", f"WITH {V.POOL} SELECT doc_id FROM pool WHERE NOT unsafe")
def e01o(t):
    return A.select_oracle(V.pool(t), "unsafe").select("doc_id")


@query("e02_select_top", f"WITH {V.POOL} SELECT doc_id, lex4 FROM ({_top('pool', 'lex4', '60')})")
def e02(t):
    return A.select_top(V.pool(t), "lex4", V.IDS, k=60).select("doc_id", "lex4")


ODD = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE lex4::DOUBLE END"


@query(
    "e02_select_top_nulls",
    f"WITH {V.POOL}, o AS (SELECT doc_id, {ODD} AS odd FROM pool), r AS (SELECT * FROM o WHERE odd IS NOT NULL AND NOT isnan(odd)) "
    f"SELECT doc_id, odd FROM r ORDER BY odd DESC, {V.tie_sql('doc_id')} LIMIT 60",
)
def e02n(t):
    """Rows without a score are never among the best."""
    odd = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("lex4"))
    return A.select_top(V.pool(t).withColumn("odd", odd.cast("double")), "odd", V.IDS, k=60).select("doc_id", "odd")


@query(
    "e02_select_top_fraction",
    f"WITH {V.HUGE}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, {V.tie_sql('row_id')}) AS rn, count(*) OVER () AS n FROM huge) "
    "SELECT row_id, score FROM r WHERE rn <= trunc(0.8::DOUBLE * n)::BIGINT",
)
def e02f(t):
    return A.select_top(V.pool_huge(t), "score", ["row_id"], frac=0.8).select("row_id", "score")


@query("e03_select_bottom", f"WITH {V.POOL} SELECT doc_id, lex4 FROM ({_top('pool', 'lex4', '60', desc=False)})")
def e03(t):
    return A.select_bottom(V.pool(t), "lex4", V.IDS, 60).select("doc_id", "lex4")


@query("e04_select_unflagged", f"WITH {V.POOL} SELECT doc_id FROM pool WHERE NOT lex8 <= -1000")
def e04(t):
    return A.select_unflagged(V.pool(t).withColumn("flag", F.col("lex8") <= -1000), "flag").select("doc_id")


@query("e04_select_cutoff", f"WITH {V.POOL} SELECT doc_id FROM pool WHERE -lex8 - 500 <= 0")
def e04c(t):
    return A.select_cutoff(V.pool(t).withColumn("odds", -F.col("lex8") - 500), "odds").select("doc_id")


@query("e05_select_labelled_safe", f"WITH {V.POOL}, {CAL} SELECT doc_id FROM cal WHERE NOT unsafe")
def e05(t):
    return A.select_labelled_safe(V.pool(t), "unsafe", CAL_N, 0, V.IDS).select("doc_id")


UNFLAGGED = "(SELECT count(*) FROM pool WHERE lex4 > -1000 AND req)"


@query(
    "e06_random_matched",
    f"WITH {V.POOL}, r AS (SELECT *, row_number() OVER (ORDER BY {V.keyed_sql('random', 3, 'doc_id')}) AS rn FROM pool) "
    f"SELECT doc_id, unsafe FROM r WHERE rn <= {UNFLAGGED}",
)
def e06(t):
    p = V.pool(t)
    return A.select_random_matched(p, p.where("lex4 > -1000 and req"), 3, V.IDS).select("doc_id", "unsafe")


@query(
    "e07_oracle_matched",
    f"WITH {V.POOL}, r AS (SELECT *, row_number() OVER (ORDER BY {V.keyed_sql('oracle', 3, 'doc_id')}) AS rn FROM pool WHERE NOT unsafe) "
    f"SELECT doc_id FROM r WHERE rn <= {UNFLAGGED}",
)
def e07(t):
    p = V.pool(t)
    return A.select_oracle_matched(p, "unsafe", p.where("lex4 > -1000 and req"), 3, V.IDS).select("doc_id")


@query(
    "e08_deciles",
    f"WITH {V.POOL} SELECT doc_id, lex4, (ntile(10) OVER (ORDER BY lex4 DESC, {TIE}) - 1)::INT AS decile FROM pool",
)
def e08(t):
    return A.with_decile(V.pool(t), "lex4", V.IDS).select("doc_id", "lex4", "decile")


@query(
    "e08_select_decile",
    f"WITH {V.HUGE}, d AS (SELECT row_id, ntile(10) OVER (ORDER BY score DESC, {V.tie_sql('row_id')}) - 1 AS decile FROM huge) "
    "SELECT row_id FROM d WHERE decile = 4",
)
def e08s(t):
    return A.select_decile(V.pool_huge(t), "score", ["row_id"], 4).select("row_id")


def _drawn(src: str, tag: str, seed: int, where: str, n: str) -> str:
    return f"(SELECT * FROM {src} WHERE {where} ORDER BY {V.keyed_sql(tag, seed, 'doc_id')} LIMIT {n})"


@query(
    "e09_dose_design",
    f"WITH {V.POOL} SELECT doc_id, unsafe, demo FROM {_drawn('pool', 'dose0.25', 1, 'unsafe', '10')} "
    f"UNION ALL SELECT doc_id, unsafe, demo FROM {_drawn('pool', 'dose0.25', 1, 'demo', '8')} "
    f"UNION ALL SELECT doc_id, unsafe, demo FROM {_drawn('pool', 'dose0.25', 1, 'NOT unsafe AND NOT demo', '22')}",
)
def e09(t):
    return A.select_dose(V.pool(t), "demo", "unsafe", 0.25, 40, 10, 1, V.IDS).select("doc_id", "unsafe", "demo")


@query(
    "e10_rank_bands",
    f"WITH {V.POOL}, r AS (SELECT doc_id, lex4, row_number() OVER (ORDER BY lex4 DESC, {TIE}) - 1 AS rn, count(*) OVER () // 3 AS third FROM pool WHERE unsafe) "
    "SELECT doc_id, lex4, CASE WHEN rn < third THEN 0 WHEN rn < 2 * third THEN 1 ELSE 2 END AS band FROM r",
)
def e10(t):
    return A.with_rank_band(V.pool(t).where("unsafe"), "lex4", V.IDS).select("doc_id", "lex4", "band")


@query(
    "e10_select_rank_band",
    f"WITH {V.POOL}, r AS (SELECT doc_id, lex4, row_number() OVER (ORDER BY lex4 DESC, {TIE}) - 1 AS rn, count(*) OVER () // 3 AS third FROM pool WHERE unsafe) "
    f"SELECT doc_id, lex4 FROM r WHERE rn >= 2 * third ORDER BY {V.keyed_sql('band2', 5, 'doc_id')} LIMIT 3",
)
def e10s(t):
    return A.select_rank_band(V.pool(t), "lex4", "unsafe", 2, 3, 5, V.IDS).select("doc_id", "lex4")


@query(
    "e11_top_per_stratum",
    f"WITH {V.POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY lex4 DESC, {TIE}) AS rn FROM pool WHERE NOT unsafe) "
    "SELECT doc_id, lang, lex4 FROM r JOIN (VALUES ('en', 40), ('fr', 5), ('de', 3)) q(lang, k) USING (lang) WHERE rn <= k",
)
def e11(t):
    ks = t.spark.createDataFrame([("en", 40), ("fr", 5), ("de", 3)], "lang string, k bigint")
    return A.select_top_per_stratum(V.pool(t).where("not unsafe"), "lex4", ["lang"], ks, V.IDS).select("doc_id", "lang", "lex4")


WANTS = {"demo": 12, "benign": 24}
LENGTH_SQL = f"""WITH {V.POOL}, ref AS (SELECT * FROM ({_top('pool', 'lex4', '50', 'WHERE NOT unsafe')})),
so AS (SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM ref),
edges AS (SELECT d, max(CASE WHEN i = ((n - 1) * d) // 10 THEN x END) + (max(CASE WHEN i = least(n - 1, ((n - 1) * d) // 10 + 1) THEN x END)
 - max(CASE WHEN i = ((n - 1) * d) // 10 THEN x END)) * ((max(n) - 1) * d % 10 / 10.0::DOUBLE) AS edge FROM so, range(1, 10) t(d) GROUP BY d),
hist AS (SELECT b AS bin, (SELECT count(*) FROM ref WHERE (SELECT count(*) FROM edges WHERE edge <= n_chars) = b) AS c FROM range(0, 10) t(b)),
q0 AS (SELECT bin, stratum, want, round_even(c / (SELECT count(*) FROM ref) * want, 0)::BIGINT AS q FROM hist, (VALUES ('demo', 12), ('benign', 24)) w(stratum, want)),
quota AS (SELECT bin, stratum, greatest(0, CASE WHEN bin < 9 THEN q ELSE want - sum(CASE WHEN bin < 9 THEN q END) OVER (PARTITION BY stratum) END)::BIGINT AS quota FROM q0),
cand AS (SELECT *, (SELECT count(*) FROM edges WHERE edge < n_chars) AS bin, CASE WHEN demo THEN 'demo' ELSE 'benign' END AS stratum FROM pool WHERE NOT unsafe),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum, bin ORDER BY {V.keyed_sql('length', 2, 'doc_id')}) AS rn FROM cand),
picked AS (SELECT r.* FROM r JOIN quota USING (stratum, bin) WHERE rn <= quota),
rest AS (SELECT *, row_number() OVER (ORDER BY {V.keyed_sql('topup', 2, 'doc_id')}) AS rn2 FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM picked))"""


def _length_arm(t: Tables):
    p = V.pool(t).where("not unsafe")
    ref = A.select_top(p, "lex4", V.IDS, k=50)
    cand = p.withColumn("stratum", F.when(F.col("demo"), F.lit("demo")).otherwise(F.lit("benign")))
    return ref, cand


@query("e12_length_quotas", f"{LENGTH_SQL} SELECT stratum, bin::INT AS bin, quota FROM quota")
def e12q(t):
    ref, _ = _length_arm(t)
    return A.length_quotas(ref, "n_chars", "stratum", WANTS, A.decile_edges(ref, "n_chars"))


@query(
    "e12_length_matched",
    f"{LENGTH_SQL} SELECT doc_id, stratum, n_chars FROM picked UNION ALL "
    "SELECT doc_id, stratum, n_chars FROM rest WHERE rn2 <= 36 - (SELECT count(*) FROM picked)",
)
def e12(t):
    ref, cand = _length_arm(t)
    return A.select_length_matched(cand, ref, "n_chars", "stratum", WANTS, 2, V.IDS).select("doc_id", "stratum", "n_chars")


@query(
    "e13_select_union",
    f"WITH {V.POOL}, {CAL} SELECT doc_id FROM ({_top('pool', 'lex4', '60')}) UNION SELECT doc_id FROM cal WHERE NOT unsafe AND req",
)
def e13(t):
    p = V.pool(t)
    extra = A.select_labelled_safe(p, "unsafe", CAL_N, 0, V.IDS).where("req")
    return A.select_union(A.select_top(p, "lex4", V.IDS, k=60), extra, V.IDS)


def stored_selections(t: Tables):
    """Several arms and seeds of the document pool as one selection table."""

    def build():
        p = V.pool(t)
        out = None
        for seed in (0, 1, 2):
            arms = {
                "full": p,
                "oracle": A.select_oracle(p, "unsafe"),
                "top": A.select_top(p, "lex4", V.IDS, k=60),
                "rejects": A.select_bottom(p, "lex4", V.IDS, 60),
                "labels": A.select_labelled_safe(p, "unsafe", CAL_N, seed, V.IDS),
            }
            for arm, rows in arms.items():
                part = rows.select(F.lit(arm).alias("arm"), F.lit(seed).alias("seed"), "doc_id")
                out = part if out is None else out.unionByName(part)
        return out

    return t.stored("selections", build)


def _seed_sql(seed: int) -> str:
    return (
        f"SELECT 'full' AS arm, {seed} AS seed, doc_id FROM pool UNION ALL SELECT 'oracle', {seed}, doc_id FROM pool WHERE NOT unsafe "
        f"UNION ALL SELECT 'top', {seed}, doc_id FROM ({_top('pool', 'lex4', '60')}) "
        f"UNION ALL SELECT 'rejects', {seed}, doc_id FROM ({_top('pool', 'lex4', '60', desc=False)}) "
        f"UNION ALL SELECT 'labels', {seed}, doc_id FROM (SELECT * FROM pool ORDER BY {V.keyed_sql('cal', seed, 'doc_id')} LIMIT {CAL_N}) WHERE NOT unsafe"
    )


SELECTIONS = "selections AS (" + " UNION ALL ".join(_seed_sql(s) for s in (0, 1, 2)) + ")"
META_SQL = """meta AS (SELECT arm, seed, count(*) AS n, sum(unsafe::INT)::BIGINT AS n_bad, avg(unsafe::INT) AS bad_frac, avg(demo::INT) AS demo_share,
 avg(CASE WHEN NOT unsafe THEN lex4 END) AS good_score_mean, avg(CASE WHEN unsafe THEN lex4 END) AS bad_score_mean,
 avg(CASE WHEN NOT unsafe THEN n_chars END) AS good_len_mean FROM selections JOIN pool USING (doc_id) GROUP BY arm, seed)"""


def meta(t: Tables):
    return A.selection_meta(stored_selections(t), V.pool(t), V.IDS, "unsafe", "demo", "lex4", "n_chars")


@query(
    "e14_selection_meta",
    f"WITH {V.POOL}, {SELECTIONS}, {META_SQL} SELECT * FROM meta",
    "bad_frac demo_share good_score_mean bad_score_mean good_len_mean",
)
def e14(t):
    return meta(t)


@query("e15_select_spectral", f"WITH {V.POOL} SELECT doc_id FROM pool WHERE -sym <= 0.01::DOUBLE")
def e15(t):
    return A.select_spectral(V.pool(t).withColumn("junk", -F.col("sym")), "junk", 0.01).select("doc_id")


@query(
    "e15_spectral_flags",
    f"WITH {V.POOL}, f AS (SELECT low_quality, -sym > 0.01::DOUBLE AS f FROM pool) SELECT sum((NOT f)::INT)::BIGINT AS n_kept, avg(f::INT) AS flagged_frac, "
    "avg(CASE WHEN low_quality THEN f::INT END) AS recall_bad, avg(CASE WHEN NOT low_quality THEN f::INT END) AS rate_good FROM f",
    "flagged_frac recall_bad rate_good",
)
def e15f(t):
    return A.spectral_flags(V.pool(t).withColumn("junk", -F.col("sym")), "junk", "low_quality", 0.01)


@query("e16_calibration_draw", f"WITH {V.POOL}, {CAL} SELECT doc_id, unsafe FROM cal")
def e16(t):
    return calibration_draw(V.pool(t), CAL_N, 0, V.IDS).select("doc_id", "unsafe")
