"""Views over the input tables, in Spark and as SQL fragments of the same rows."""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.hashing import draw_key, hex_number
from plumbline.operators.pools import dedup_exclude
from plumbline.plans.registry import Tables

LEX4 = ("trash", "idiot", "scum", "clown")
LEX8 = (*LEX4, "worthless", "moron", "pathetic", "loser")
JUDGES = ("j1", "j2", "j3", "j4")
ARMS = ("full", "certified", "stratified", "random", "labels", "oracle")
SEEDS = (0, 1, 2)

IDS = ["doc_id"]


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels, texts included."""
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "text", "lang", "source", "n_chars",
        (F.col("toxic") == 1).alias("unsafe"),
        (F.col("quality") == 0).alias("low_quality"),
        (F.col("lang") != "en").alias("req"),
    )


def pool(t: Tables) -> DataFrame:
    """The scored pool: one pass over the texts, then a narrow table."""

    def build() -> DataFrame:
        return labelled(t).select(
            "doc_id", "lang", "source", "n_chars", "unsafe", "low_quality", "req",
            (F.col("req") & ~F.col("unsafe")).alias("demo"),
            T.lexicon_score("text", "n_chars", LEX4).alias("lex4"),
            T.lexicon_score("text", "n_chars", LEX8).alias("lex8"),
            (-F.col("n_chars")).cast("double").alias("len_score"),
            T.symbol_score("text", "n_chars").alias("sym"),
        )

    return t.stored("pool", build)


POOL = """pool AS (SELECT doc_id, lang, source, n_chars, toxic = 1 AS unsafe, quality = 0 AS low_quality,
 lang <> 'en' AS req, (lang <> 'en' AND toxic <> 1) AS demo,
 (-(1000 * regexp_matches(lower(text), 'trash|idiot|scum|clown')::INT + n_chars % 97))::DOUBLE AS lex4,
 (-(1000 * regexp_matches(lower(text), 'trash|idiot|scum|clown|worthless|moron|pathetic|loser')::INT + n_chars % 97))::DOUBLE AS lex8,
 (-n_chars)::DOUBLE AS len_score,
 (-(length(text) - length(regexp_replace(text, '[!?*#%@]', '', 'g')))::DOUBLE / n_chars::DOUBLE) AS sym
 FROM documents JOIN labels USING (doc_id))"""


def pool_big(t: Tables) -> DataFrame:
    """Events as a pool with an uninformative score."""
    req = F.col("event_type").isin("click", "view", "error") & (F.col("user_id") % 2 == 0)
    bad = F.col("event_type") == "error"
    return t.events.select(
        "event_id", bad.alias("unsafe"), req.alias("req"), (req & ~bad).alias("demo"),
        F.col("value").alias("score"), "user_id", "event_type",
    )


BIG = """big AS (SELECT event_id, event_type = 'error' AS unsafe,
 (event_type IN ('click', 'view', 'error') AND user_id % 2 = 0) AS req,
 (event_type IN ('click', 'view', 'error') AND user_id % 2 = 0 AND event_type <> 'error') AS demo,
 value AS score, user_id, event_type FROM events)"""


def pool_huge(t: Tables) -> DataFrame:
    """Line items, one per (order, line): the pair is not unique in the table."""
    key = ["l_orderkey", "l_linenumber"]

    def build() -> DataFrame:
        cols = t.lineitem.select(
            *key, "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"
        )
        return dedup_exclude(cols, key, ["l_partkey", "l_suppkey", "l_extendedprice"]).select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
            (F.col("l_returnflag") == "R").alias("unsafe"),
            (F.col("l_linestatus") == "O").alias("req"),
            (-F.col("l_extendedprice")).alias("score"),
        )

    return t.stored("pool_huge", build)


HUGE = """huge AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_returnflag = 'R' AS unsafe,
 l_linestatus = 'O' AS req, -l_extendedprice AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"""


def qa_pairs(t: Tables) -> DataFrame:
    """User turns answered by the next turn of the conversation.

    Turns are numbered without gaps, so the answer is found by an equality join
    on (conversation, turn): unlike a window, a conversation that holds a third
    of the table still spreads over all tasks.
    """
    c = t.conversations
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    given = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(given, ["conv_id", "turn"])


QA = """qa AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant')"""


def paired_responses(t: Tables) -> DataFrame:
    """Neighbouring documents as two responses to one prompt; one side's label is a string."""
    d = labelled(t).withColumn("pair", F.floor(F.col("doc_id") / 2))
    even = d.where("doc_id % 2 = 0").select(
        "pair", F.concat_ws(":", "lang", "source").alias("prompt"),
        F.col("text").alias("response_0"), (~F.col("unsafe")).alias("is_response_0_safe"),
    )
    odd = d.where("doc_id % 2 = 1").select(
        "pair", F.col("text").alias("response_1"),
        F.initcap((~F.col("unsafe")).cast("string")).alias("is_response_1_safe"),
    )
    return even.join(odd, "pair")


PAIRED = """labelled AS (SELECT doc_id, doc_id // 2 AS pair, lang, source, text, toxic = 1 AS unsafe FROM documents JOIN labels USING (doc_id)),
paired AS (SELECT e.pair, e.lang || ':' || e.source AS prompt, e.text AS response_0, NOT e.unsafe AS is_response_0_safe,
 o.text AS response_1, CASE WHEN o.unsafe THEN 'False' ELSE 'True' END AS is_response_1_safe
 FROM labelled e JOIN labelled o ON e.pair = o.pair AND e.doc_id % 2 = 0 AND o.doc_id % 2 = 1)"""


def verdicts(t: Tables, items: DataFrame | None = None) -> DataFrame:
    """The verdict store: every judge's verdict on every document under every arm and seed.

    ``items``: columns of documents by ``item_no``. They meet the labels before
    these are laid out, so a document is joined once and not once for each verdict.
    The layout is a join with a small table, as the size that Spark expects of a join
    grows with both sides: an exploded array counts as one row, and the store,
    many times its labels, would be broadcast.
    """
    d = t.labels.select(F.col("doc_id").alias("item_no"), "toxic")
    if items is not None:
        d = d.join(items, "item_no")
    names, rows = ("judge", "arm", "seed"), product(JUDGES, ARMS, SEEDS)
    panel = t.spark.createDataFrame(pa.table(dict(zip(names, zip(*rows)))), "judge string, arm string, seed int")
    h = F.md5(F.concat_ws(":", "judge", "arm", F.col("seed").cast("string"), F.col("item_no").cast("string")))
    return (
        d.crossJoin(panel)
        .withColumn("_h", h)
        .withColumn("score", 0.5972347 * (hex_number(F.col("_h"), 4) / 65536.0) + 0.4 * F.col("toxic"))
        .select(
            F.concat(F.col("arm"), F.lit("_s"), F.col("seed").cast("string")).alias("model"),
            "arm", "seed", "judge", "item_no", "score",
            (F.col("score") > 0.5).alias("flag"),
            (F.conv(F.substring("_h", 5, 1), 16, 10).cast("int") % 4 == 0).alias("refusal"),
            (F.col("toxic") == 1).alias("unsafe"),
            *[c for c in (items.columns if items is not None else []) if c != "item_no"],
        )
    )


VERDICTS = """verdicts AS (SELECT arm || '_s' || seed AS model, arm, seed, judge, doc_id AS item_no, score, score > 0.5::DOUBLE AS flag,
 ('0x' || substr(h, 5, 1))::INT % 4 = 0 AS refusal, toxic = 1 AS unsafe FROM (
 SELECT *, 0.5972347::DOUBLE * (('0x' || substr(h, 1, 4))::BIGINT / 65536.0::DOUBLE) + 0.4::DOUBLE * toxic AS score FROM (
 SELECT doc_id, toxic, judge, arm, seed, md5(judge || ':' || arm || ':' || seed || ':' || doc_id) AS h FROM labels,
 unnest(['j1', 'j2', 'j3', 'j4']) a(judge), unnest(['full', 'certified', 'stratified', 'random', 'labels', 'oracle']) b(arm),
 unnest([0, 1, 2]) c(seed))))"""


# ---- SQL fragments of the ranking and testing rules

GRID_SQL = "[85, 80, 75, 70, 65, 60, 55, 50, 45, 40, 35, 30]"


def keyed_sql(tag: str, seed: int | str, ident: str) -> str:
    return f"md5('{tag}:{seed}:' || {ident})"


def tie_sql(ident: str) -> str:
    return keyed_sql("tie", 0, ident)


def _on(keys: tuple[str, ...], a: str, b: str) -> str:
    return " AND ".join([*(f"{a}.{k} = {b}.{k}" for k in keys), "TRUE"])


def curve_sql(src: str, score: str, bad: str, keys: tuple[str, ...] = (), grid: str = GRID_SQL, wanted: str | None = None) -> str:
    """CTEs ``taus`` and ``curve``: cutoffs and the composition of their kept sets."""
    k = "".join(f"{c}, " for c in keys)
    tk = "".join(f"t.{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f", sum(({wanted})::INT)::BIGINT AS w_sel" if wanted else ""
    return f"""ranked AS (SELECT {k}{score} AS s, row_number() OVER ({part}ORDER BY {score}) AS rn,
 count(*) OVER ({part.strip()}) AS n_pool FROM {src}),
taus AS (SELECT {k}q100, n_pool, s AS tau FROM ranked, unnest({grid}) g(q100)
 WHERE rn = ((n_pool - 1) * q100 + 99) // 100 + 1),
curve AS (SELECT {tk}q100, n_pool, tau, count(*) AS n_sel, sum(({bad})::INT)::BIGINT AS k_sel{w}
 FROM taus t JOIN {src} p ON {_on(keys, 't', 'p')} AND p.{score} >= t.tau GROUP BY ALL)"""


def audit_sql(cal: str, score: str, bad: str, keys: tuple[str, ...] = (), wanted: str | None = None) -> str:
    """CTE ``counts``: calibration rows and bad rows each cutoff keeps."""
    w = f", coalesce(sum(({wanted})::INT), 0)::BIGINT AS k_wanted" if wanted else ""
    return f"""counts AS (SELECT c.* , x.m, x.k{', x.k_wanted' if wanted else ''} FROM curve c JOIN (
 SELECT {''.join(f't.{c}, ' for c in keys)}t.q100, count(p.{score}) AS m, coalesce(sum(p.{bad}::INT), 0)::BIGINT AS k{w}
 FROM taus t LEFT JOIN {cal} p ON {_on(keys, 't', 'p')} AND p.{score} >= t.tau GROUP BY ALL) x
 ON {_on((*keys, 'q100'), 'c', 'x')})"""


def lnc(a: str, b: str) -> str:
    return f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"


def _terms(first: str, last: str, pop: str, bad: str, draws: str) -> str:
    return (
        f"least(1.0::DOUBLE, list_sum(list_transform(range({first}, ({last}) + 1), lambda j: "
        f"exp({lnc(bad, 'j')} + {lnc(f'({pop}) - ({bad})', f'({draws}) - j')} - {lnc(pop, draws)}))))"
    )


def cdf_sql(k: str, pop: str, bad: str, draws: str) -> str:
    lo, hi = f"greatest(0, ({draws}) - (({pop}) - ({bad})))", f"least({draws}, {bad})"
    return (
        f"(CASE WHEN {k} < {lo} THEN 0.0::DOUBLE WHEN {k} >= {hi} THEN 1.0::DOUBLE "
        f"ELSE {_terms(lo, k, pop, bad, draws)} END)"
    )


def tail_sql(k: str, pop: str, bad: str, draws: str) -> str:
    lo, hi = f"greatest(0, ({draws}) - (({pop}) - ({bad})))", f"least({draws}, {bad})"
    return (
        f"(CASE WHEN {k} <= {lo} THEN 1.0::DOUBLE WHEN {k} > {hi} THEN 0.0::DOUBLE "
        f"ELSE {_terms(k, hi, pop, bad, draws)} END)"
    )


def p_upper_sql(k: str, m: str, n_sel: str, alpha: str) -> str:
    ks = f"(trunc(({alpha})::DOUBLE * ({n_sel})::DOUBLE)::BIGINT + 1)"
    return f"(CASE WHEN {m} = 0 OR {ks} > {n_sel} THEN 1.0::DOUBLE ELSE {cdf_sql(k, n_sel, ks, m)} END)"


def p_lower_sql(k: str, m: str, n_sel: str, beta: str) -> str:
    kd = f"(ceil(({beta})::DOUBLE * ({n_sel})::DOUBLE)::BIGINT - 1)"
    return f"(CASE WHEN {m} = 0 OR {kd} < 0 THEN 1.0::DOUBLE ELSE {tail_sql(k, n_sel, kd, m)} END)"


def walk_sql(src: str, ok: str, keys: tuple[str, ...] = ()) -> str:
    """CTE ``audit`` over ``src``: passed, tested and deployed cutoffs."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"({part}ORDER BY q100 DESC)"
    return f"""walked AS (SELECT *, bool_and({ok}) OVER ({part}ORDER BY q100 DESC ROWS UNBOUNDED PRECEDING) AS passed,
 coalesce(bool_and({ok}) OVER ({part}ORDER BY q100 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS tested
 FROM {src}),
audit AS (SELECT *, passed AND NOT coalesce(lead(passed) OVER {w}, false) AS deployed FROM walked)"""


def auroc_sql(src: str, score: str, label: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {k}(sum(CASE WHEN pos THEN r END) - np * (np + 1) / 2) / (np * nn) AS auroc FROM (SELECT {k}{label} AS pos, "
        f"rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({'PARTITION BY ' + k + score}) - 1) / 2 AS r, "
        f"sum(({label})::INT) OVER ({part})::DOUBLE AS np, sum((NOT {label})::INT) OVER ({part})::DOUBLE AS nn FROM {src}) {g + ', np, nn' if g else 'GROUP BY np, nn'}"
    )


def cp_sql(s: str, n: str, delta: str) -> str:
    """Clopper-Pearson lower bound by the same bisection."""
    def tail(p: str) -> str:
        return (
            f"least(1.0::DOUBLE, list_sum(list_transform(range({s}, ({n}) + 1), lambda j: "
            f"exp({lnc(n, 'j')} + j * ln({p}) + (({n}) - j) * ln(1 - {p})))))"
        )

    mid = "((z.lo + z.hi) / 2)"
    fold = (
        f"list_reduce(range(0, 50), lambda z, i: {{'lo': CASE WHEN {tail(mid)} > {delta} THEN z.lo ELSE {mid} END, "
        f"'hi': CASE WHEN {tail(mid)} > {delta} THEN {mid} ELSE z.hi END}}, {{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}})"
    )
    return f"(CASE WHEN {s} > 0 THEN (SELECT (b.lo + b.hi) / 2 FROM (SELECT {fold} AS b)) ELSE 0.0::DOUBLE END)"
