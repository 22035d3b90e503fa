"""Lookups, audit and data-quality checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions import text as T
from plumbline.operators.ranking import cuts_of, value_cuts
from plumbline.session import settle


def first_contrast(
    verdicts: DataFrame,
    gens: DataFrame,
    flagged: str,
    clean: str,
    judges: list[str],
    max_len: int,
    blocked: tuple[str, ...],
    prompts: DataFrame,
) -> DataFrame:
    """G1: the first item every judge flags under one model and none under another.

    All responses to the item must be short, and neither they nor the prompt may
    contain a blocked word. One aggregation per table, then a minimum.
    """
    is_a, is_b = F.col("model") == flagged, F.col("model") == clean
    contrast = (
        verdicts.where(F.col("judge").isin(judges) & (is_a | is_b))
        .groupBy("item_no")
        .agg(
            F.count_if(is_a & F.col("flag")).alias("_a"),
            F.count_if(is_b).alias("_b_seen"),
            F.count_if(is_b & F.col("flag")).alias("_b"),
        )
        .where((F.col("_a") == len(judges)) & (F.col("_b_seen") == len(judges)) & (F.col("_b") == 0))
    )
    printable = (
        gens.groupBy("item_no")
        .agg(F.bool_and(T.eligible(["response"], [max_len], blocked)).alias("_ok"))
        .where("_ok")
    )
    clean_prompt = prompts.where(T.eligible(["prompt"], [2_000_000_000], blocked))
    hits = contrast.join(printable, "item_no").join(clean_prompt, "item_no")
    first = hits.agg(F.min_by(F.struct("item_no", "prompt"), "item_no").alias("_f"))
    return first.select("_f.*").where("item_no is not null")


def group_medians(df: DataFrame, group: str, score: str) -> DataFrame:
    """Median of each group (middle values averaged), exact and without collecting a group."""
    cuts = cuts_of((0, "(n_total + 1) div 2"), (1, "n_total div 2 + 1"))
    mids = value_cuts(df.select(group, F.col(score).cast("double").alias(score)), score, cuts, [group])
    return mids.groupBy(group).agg(F.avg("value").alias("median"))


def representatives(df: DataFrame, group: str, score: str, ok: Column, ids: list[str]) -> DataFrame:
    """The eligible row of each group whose score is closest to the group's median.

    The median is over the whole group; ties go to the smaller id.
    """
    near = F.struct(F.abs(F.col(score) - F.col("median")).alias("_d"), *ids)
    return (
        df.join(group_medians(df, group, score), group)
        .where(ok)
        .groupBy(group)
        .agg(F.min_by(F.struct(*ids, score, "median"), near).alias("_r"))
        .select(group, "_r.*")
    )


def coverage(required: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """H1: every required cell with how many seeds exist; ``required`` has ``min_seeds``."""
    have = actual.groupBy(*keys).agg(F.countDistinct("seed").alias("n_seeds"))
    return (
        required.join(have, keys, "left")
        .fillna({"n_seeds": 0})
        .withColumn("status", F.when(F.col("n_seeds") >= F.col("min_seeds"), F.lit("PASS")).otherwise(F.lit("FAIL")))
    )


def expectations(df: DataFrame) -> DataFrame:
    """H2: scalar checks, |claimed - actual| within tolerance."""
    ok = F.abs(F.col("claimed") - F.col("actual")) <= F.col("tolerance")
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))


def list_expectations(df: DataFrame) -> DataFrame:
    """H2: list checks, equal length and every element within tolerance."""
    near = F.forall(
        F.zip_with("claimed", "actual", lambda a, b: F.abs(a - b)),
        lambda d: F.coalesce(d <= F.col("tolerance"), F.lit(False)),
    )
    return df.withColumn("ok", (F.size("claimed") == F.size("actual")) & near)


def malformed_json(df: DataFrame, file: str, json: str) -> DataFrame:
    """H3: the files whose text is no JSON, as (file, error); ``flatten_json`` has no rows of them."""
    return df.where(F.col(json).isNull() | F.try_parse_json(json).isNull()).select(
        F.col(file).alias("file"), F.when(F.col(json).isNull(), "no text").otherwise("not JSON").alias("error")
    )


def json_depth(json: Column) -> Column:
    """How deep objects and lists of a JSON text are nested; brackets inside strings do not count."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, bracket: Column) -> Column:
        now = at["now"] + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(bare, F.lit(r"([\[\]{}])")), start, step)["most"]


def flatten_json(df: DataFrame, file: str, json: str, list_limit: int | None = None) -> DataFrame:
    """H3: every number of a nested JSON text as (file, path, value).

    One pass finds how deep the texts are nested; the rest is a single plan of so many
    explodes, in which values without parts pass through, so no level is stored or
    opened twice. Booleans and strings are not numbers; lists are read whole, or up to
    ``list_limit`` elements. Texts that do not parse give no rows here: ``malformed_json`` reports them.
    """
    spark = df.sparkSession
    level = df.select(F.col(file).alias("file"), F.lit("").alias("path"), F.try_parse_json(json).alias("v"), F.col(json).alias("_json"))
    level = level.where(F.col("v").isNotNull())
    depth = level.agg(F.max(json_depth(F.col("_json")))).first()[0] or 0
    level = level.drop("_json")
    for _ in range(depth):
        opened = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "key", "value"))
        if list_limit is not None:
            opened = opened.where(F.col("pos").isNull() | F.col("key").isNotNull() | (F.col("pos") < list_limit))
        step = F.when(F.col("pos").isNull(), "").when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(
            F.concat(F.lit("/"), F.col("key"))
        )
        part = F.when(F.col("pos").isNull(), F.col("v")).otherwise(F.col("value"))
        level = opened.select("file", F.concat("path", step).alias("path"), part.alias("v"))
    number = F.schema_of_variant("v").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return level.where(number).select("file", "path", F.try_variant_get("v", "$", "double").alias("value"))


# A number standing alone, its context window, contexts that name protocol
# settings, settings that need no source, and the span read as calendar years.
NUMBER = r"(\d+\.\d+|\d{2,})(?![\w.%])"
ALONE = r"(?<![\w.\-])"
CONTEXT_BEFORE, CONTEXT_AFTER = 60, 30
PROTOCOL_PATTERN = (
    r"epochs?|batch|learning rate|tokens?|characters?|rank|dropout|max(imum)? length"
    r"|percent of the pool|quantiles?|\\times|10\^|pools? of|N = |examples per|draws|prompts|labels|n = "
)

KNOWN_SETTINGS = ("0.10", "0.25", "0.30", "0.15", "0.20", "0.85", "0.80", "0.05", "0.50", "0.90", "0.95")
YEARS = (1900, 2100)


BLOCK = 64


def running_starts(lengths: str) -> tuple[Column, Callable[[str], Column]]:
    """Where each of consecutive pieces starts, from an array column of their lengths, in two steps.

    The first column has the start of every BLOCK-th piece; the second, made from the first
    one's name, all starts. An array that grows by one at a time is copied each
    time: here only that of the blocks is.
    """
    n = f"size({lengths})"
    sums = f"transform(sequence(0, greatest(0, ({n} - 1) div {BLOCK})), b -> aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x))"
    blocks = F.expr(f"aggregate({sums}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))")

    def starts(at: str) -> Column:
        return F.expr(
            f"transform({lengths}, (x, i) -> {at}[i div {BLOCK}] + aggregate(slice({lengths}, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK}), 0, (a, y) -> a + y))"
        )

    return blocks, starts


def extract_numbers(df: DataFrame, ids: list[str], text: str, skip_settings: bool = True) -> DataFrame:
    """H4: numeric literals of a text with their position.

    With ``skip_settings`` a literal is left out when it is a known setting, a
    year, or stands in a context that names one.

    One pass of the pattern marks each literal, with its context beside it where that
    is needed; the marked text is cut there, running lengths give the positions, and what
    is left out goes before literals become rows, so a row carries no text.
    """
    # the marks must not occur in the text itself, and a character is one unit of the pattern's; as long a stand-in keeps all positions
    plain = F.regexp_replace(F.col(text), "[\u0001-\u0004]|[^\u0000-\uffff]", "\u0005")
    if skip_settings:
        near = rf"(?=\d)(?<=(?s:(\A.{{0,{CONTEXT_BEFORE - 1}}}|.{{{CONTEXT_BEFORE}}}))){NUMBER}(?=((?s:.{{0,{CONTEXT_AFTER}}})))"
        marked = F.regexp_replace(plain, ALONE + near, "\u0001$1\u0002$2\u0003$3\u0004")
    else:
        marked = F.regexp_replace(plain, ALONE + NUMBER, "\u0001\u0002$1\u0003\u0004")
    df = df.select(*ids, F.split(marked, "\u0001").alias("_pieces"))
    # before, literal, after, rest of the text up to the next literal; the first piece is text alone
    df = df.withColumn("_parts", F.transform("_pieces", lambda p: F.split(p, "[\u0002-\u0004]"))).drop("_pieces")
    df = df.withColumn("_lengths", F.transform("_parts", lambda p: F.when(F.size(p) == 1, F.length(p[0])).otherwise(F.length(F.get(p, F.lit(1))) + F.length(F.get(p, F.lit(3))))))
    blocks, starts = running_starts("_lengths")
    df = df.withColumn("_blocks", blocks).withColumn("_starts", starts("_blocks"))
    found = F.transform(
        F.slice("_parts", F.lit(2), F.size("_parts")),
        lambda p, i: F.struct(F.get(F.col("_starts"), i + 1).alias("pos"), p[1].alias("literal"), F.concat(p[0], p[1], p[2]).alias("context")),
    )
    df = df.select(*ids, found.alias("_found"))
    if skip_settings:
        def wanted(x: Column) -> Column:
            number = x["literal"].cast("double")
            year = ~x["literal"].contains(".") & (number > YEARS[0]) & (number < YEARS[1])
            return ~x["context"].rlike(PROTOCOL_PATTERN) & ~x["literal"].isin(*KNOWN_SETTINGS) & ~year

        df = df.withColumn("_found", F.filter("_found", wanted))
    slim = F.transform("_found", lambda x: F.struct(x["pos"].alias("pos"), x["literal"].alias("literal")))
    return df.select(*ids, F.inline(slim))


def decimals(literal: str | Column) -> Column:
    c = F.col(literal) if isinstance(literal, str) else literal
    return F.length(F.regexp_extract(c, r"\.(\d+)$", 1))


MOST_DECIMALS = 17  # beyond these a double has none


@F.pandas_udf(StringType())
def printed(value: pd.Series, places: pd.Series) -> pd.Series:
    """A double as it prints with so many decimals: the exact binary value, rounded once."""
    return pd.Series([None if pd.isna(v) else f"{v:.{k}f}" for v, k in zip(value, places)], dtype="object")


def shown_values(values: DataFrame, keys: list[str], value: str, places: list[int]) -> DataFrame:
    """(keys, value, n_values, shown): the texts under which each distinct value can be printed.

    A value prints as it is, without sign, or as a percentage up to 100, with each of
    the numbers of decimals in ``places``. Texts are keys that any value has, however large.
    """
    forms = F.array(
        F.struct(F.abs("value").alias("_x"), F.lit(False).alias("_percent")), F.struct((F.col("value") * 100).alias("_x"), F.lit(True).alias("_percent"))
    )
    each = values.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n_values")
    )
    each = each.select("*", F.explode(F.lit(places).cast("array<int>")).alias("_k")).select("*", F.inline(forms))
    each = each.withColumn("shown", printed("_x", "_k"))
    return each.where(~F.col("_percent") | (F.col("shown").try_cast("double") <= 100)).select(*keys, "value", "n_values", "shown").distinct()


def as_printed(literal: str) -> Column:
    """A literal without leading zeros, as ``printed`` writes it."""
    return F.regexp_replace(F.col(literal), r"^0+(?=\d)", "")


def _places(literals: DataFrame) -> list[int]:
    """The numbers of decimals that occur, at most MOST_DECIMALS + 1 of them."""
    rows = literals.select(decimals("literal").alias("k")).where(F.col("k") <= MOST_DECIMALS).distinct().collect()
    return sorted(r.k for r in rows)


def trace(literals: DataFrame, values: DataFrame) -> DataFrame:
    """H5: which stored values print as a literal: as they are, without sign, or as a percentage.

    Values are printed once for each number of decimals that literals have, so the match is
    an equality join on the text instead of a comparison of all pairs. Literals are read
    and counted once, and stored as counts. Unmatched literals come back with no value: they are the orphans.
    """
    wanted = settle(literals.groupBy("literal").agg(F.count(F.lit(1)).alias("n_uses")))
    shown = shown_values(values, [], "value", _places(wanted))
    return wanted.withColumn("shown", as_printed("literal")).join(shown, "shown", "left").select("literal", "n_uses", "value", "n_values")


def named_in(sentence: str, names: list[str]) -> Column:
    """The names that occur in a sentence, whatever their case."""
    return F.filter(F.lit(names).cast("array<string>"), lambda n: F.contains(F.lower(F.col(sentence)), F.lower(n)))


def trace_scoped(
    literals: DataFrame, ids: list[str], sentence: str, values: DataFrame, key: str, value: str, names: dict[str, list[str]]
) -> DataFrame:
    """H5 by scope: (ids, literal, names, outcome) of every literal of every sentence.

    ``names`` says which keys of ``values`` a name stands for: a key itself or all that
    begin with it and an underscore. A literal is looked up among the values of the names its
    sentence has, or among all where it has none: it is ``matched``, or only prints a value that
    ``exists elsewhere``, or is an ``orphan``. Equal literals with equal names are looked up once.
    """
    prefixes = sorted({p for ps in names.values() for p in ps})
    stands_for = F.create_map(*[x for n, ps in names.items() for x in (F.lit(n), F.lit(ps).cast("array<string>"))])
    asked = literals.select(*ids, "literal", named_in(sentence, list(names)).alias("names"))
    asked = settle(asked.withColumn("_cell", F.xxhash64("literal", "names")))
    cells = settle(asked.select("_cell", "literal", "names").distinct())
    of = F.filter(F.lit(prefixes).cast("array<string>"), lambda p: (F.col(key) == p) | F.startswith(F.col(key), F.concat(p, F.lit("_"))))
    scoped = values.select(value, F.explode(F.concat(F.array(F.lit("")), F.coalesce(of, F.array().cast("array<string>")))).alias("_scope"))
    shown = settle(shown_values(scoped, ["_scope"], value, _places(cells)).select("_scope", "shown").distinct())
    looked = F.when(F.size("names") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.transform("names", lambda n: stands_for[n]))))
    wanted = cells.select("_cell", "literal", as_printed("literal").alias("shown"), F.explode(F.concat(looked, F.array(F.lit("")))).alias("_scope"), F.col("names"))
    own = (F.col("_scope") != "") | (F.size("names") == 0)
    hits = wanted.join(shown, ["_scope", "shown"]).groupBy("_cell", "literal", "names").agg(F.max(own).alias("own"))
    outcome = F.when(F.col("own"), "matched").when(F.col("own").isNotNull(), "exists elsewhere").otherwise("orphan")
    decided = cells.join(hits, ["_cell", "literal", "names"], "left").select("_cell", "literal", "names", outcome.alias("outcome"))
    return asked.join(decided, ["_cell", "literal", "names"]).select(*ids, "literal", "names", "outcome")


def value_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """H6: buckets holding more than one distinct value, one row per value."""
    per_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_uses"))
    many = per_value.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    return per_value.join(many, keys)


def sentences(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """H7: the sentences of a text that hold a digit, in order."""
    return (
        df.select(*ids, F.posexplode(T.sentences(text)).alias("pos", "sentence"))
        .where(F.col("sentence").rlike(r"\d"))
        .select(*ids, "pos", F.trim("sentence").alias("sentence"))
    )


def count_phrases(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """H7: count phrases such as "three of the five" or "2/3"."""
    return df.select(*ids, F.explode(T.count_phrases(text)).alias("phrase"))


def snapshot_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """H8: rows only in one of two tables, and whether they are equal."""
    gone = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"), F.lit(0).alias("_one"))
    new = b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"), F.lit(0).alias("_one"))
    return gone.join(new, "_one").select(
        "only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal")
    )
