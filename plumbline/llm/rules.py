"""Quality rules: counts of a text, and how far its histograms lie from its language's.

Two histograms of each document, of character classes and of common words, are
compared with references of its language by Jensen-Shannon divergence (0: equal,
1: disjoint). References come from the corpus: every value of ``lang`` with at least
REFERENCE_CHARS code points has one for its classes, and with at least REFERENCE_WORDS words one for its
common words, those with at least COMMON_SHARE of the language's words, so each list is bounded
whatever the corpus. They are tables joined by ``lang``. Where a language has too
little text for a reference, and for rows without a language, there is nothing to compare with and divergence
says nothing; nor does it for short texts, whose histograms say little.

Everything is SQL functions over the row; no text moves. Inside expressions a
value that is used again is bound to a lambda's variable (``bind``), as Spark would
otherwise compute it once for each use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import pin, settle

GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\r\u000b\f"
SYMBOLS = "#*$%&|<>"
SENTENCE = ".,;:!?"
PLAIN_GAP = rf"[\x20\x09-\x0D{SENTENCE}]+"
CLASSES = ("lower", "space", "upper", "letter", "digit", "sentence", "symbol")
REFERENCE_CHARS, REFERENCE_WORDS = 50_000, 10_000
COMMON_SHARE = 0.004
CLASS_LIMIT, CLASS_CHARS = 0.06, 200
WORD_LIMIT, WORD_WORDS = 0.12, 80
LEAST_WORDS = 50


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


FEW = 64


def _covered(at: Column) -> Column:
    """Words that windows of three cover, from the windows' ascending starts."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"]
    )


def repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: words inside 3-word windows that occur twice or more in the text.

    Sorted window hashes show which ones repeat. A few of them are looked up for each
    window; of many, sorted pairs of hash and place give the places, so the
    work stays within n log n.
    """

    def windows(w: Column) -> Column:
        first, second, third = (F.slice(w, k, F.size(w) - 2) for k in (1, 2, 3))
        return F.zip_with(F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)), third, lambda a, b: F.xxhash64(a, b))

    def places(s: Column) -> Column:
        return F.filter(
            s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        )

    none = F.lit([]).cast("array<long>")
    hashes = F.when(F.size(words) < 3, none).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), windows))
    df = df.withColumn("_h", hashes).withColumn("_s", F.sort_array("_h"))
    df = df.withColumn("_dup", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (F.get(F.col("_s"), i - 1) == x))))
    looked_up = F.filter(F.transform("_h", lambda x, i: F.when(F.array_contains("_dup", x), i).otherwise(-1)), lambda i: i >= 0)
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    sorted_out = F.sort_array(F.transform(bind(pairs, places), lambda x: x["i"]))
    count = (
        F.when(F.size("_dup") == 0, F.lit(0).cast("long"))
        .when(F.size("_dup") <= FEW, _covered(looked_up))
        .otherwise(_covered(sorted_out))
    )
    return df.withColumn(out, count).drop("_h", "_s", "_dup")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_counts(df: DataFrame, text: str) -> DataFrame:
    """Add ``classes``: code points of each class, each counted on what the classes before it left over."""
    patterns = ("[a-z]+", GAP, "[A-Z]+", r"[\p{L}\p{M}]+", "[0-9]+", f"[{SENTENCE}]+")
    at, counts = F.col(text), []
    for i, p in enumerate(patterns):
        df = df.withColumn(f"_left{i}", F.regexp_replace(at, p, ""))
        counts.append(F.length(at) - F.length(f"_left{i}"))
        at = F.col(f"_left{i}")
    counts.append(F.length(at))
    return df.withColumn("classes", F.array(*counts)).drop(*[f"_left{i}" for i in range(len(patterns))])


def divergence(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon divergence in bits between counts and reference shares; null without counts."""
    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def over(t: Column) -> Column:
        parts = F.zip_with(counts, shares, lambda c, q: F.struct((c / t).alias("p"), q.alias("q")))
        return F.aggregate(
            parts, F.lit(0.0),
            lambda a, x: a + (term(x["p"], (x["p"] + x["q"]) / 2) + term(x["q"], (x["p"] + x["q"]) / 2)) / 2,
        )

    return bind(total, lambda t: F.when(t > 0, over(t)))


def _plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), PLAIN_GAP), lambda w: w != "")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common, shares, longest): common words of each language, most common first, their shares and the rest's."""
    words = docs.filter("lang is not null").select("lang", F.explode(_plain_words(F.col("text"))).alias("word"))
    counts = settle(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    # pinned, as a join of unknown size would bring all words of a language into one task
    totals = pin(counts.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= REFERENCE_WORDS))
    often = counts.join(totals, "lang").filter(F.col("n") >= COMMON_SHARE * F.col("total"))
    lists = often.groupBy("lang", "total").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("top"))  # at most 1 / COMMON_SHARE
    shares = F.transform("top", lambda t: -t["n"] / F.col("total"))
    rest = F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return settle(lists.select(
        "lang", F.col("top.word").alias("common"), F.concat(shares, F.array(F.greatest(rest, F.lit(0.0)))).alias("shares"),
        F.aggregate("top.word", F.lit(0), lambda a, w: F.greatest(a, F.octet_length(w))).alias("longest"),
    ))


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, lang, all counts of every row, and ``shares`` of its language's common words; ``commons`` is null where there are none."""
    base = class_counts(docs, "text").withColumn("words", words_of(F.col("text")))
    base = repeat_words(base, "words", "n_repeat_words").join(common, "lang", "left")

    def counts(pair: Column) -> Column:
        hits = F.filter(pair["w"], lambda w: (F.octet_length(w) <= pair["longest"]) & F.array_contains(pair["c"], w))
        return bind(
            F.struct(hits.alias("h"), pair["c"].alias("c"), F.size(pair["w"]).alias("n")),
            lambda x: F.concat(
                F.transform(x["c"], lambda c: F.size(F.filter(x["h"], lambda w: w == c))), F.array(x["n"] - F.size(x["h"]))
            ),
        )

    pair = F.struct(_plain_words(F.col("text")).alias("w"), F.col("common").alias("c"), "longest")
    return base.select(
        "doc_id", "lang", F.char_length("text").cast("long").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        "n_repeat_words",
        "classes",
        F.when(F.col("common").isNotNull(), bind(pair, counts)).alias("commons"),
        F.col("shares").alias("common_shares"),
    )


def class_references(table: DataFrame) -> DataFrame:
    """(lang, class_shares): shares of the character classes in each language's rows."""
    sums = table.filter("lang is not null").groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))])
    total = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    return sums.filter(total >= REFERENCE_CHARS).select("lang", F.array(*[F.col(f"c{i}") / total for i in range(len(CLASSES))]).alias("class_shares"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, both divergences, kept, for every row.

    A null text has no words; it and the empty text fail the base rule. Rows with a null
    language, or one with too little text in the table, have null divergences and are judged
    by the base rule alone. Repeated rows give repeated rows; an empty table gives none;
    columns other than doc_id, text and lang are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    table = settle(features(base, common_words(base)))
    judged = (
        table.join(class_references(table), "lang", "left")
        .withColumn("class_divergence", F.when(F.col("class_shares").isNotNull(), divergence(F.col("classes"), F.col("class_shares"))))
        .withColumn("word_divergence", F.when(F.col("commons").isNotNull(), divergence(F.col("commons"), F.col("common_shares"))))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )
    odd_letters = (F.col("n_chars") >= CLASS_CHARS) & (F.coalesce("class_divergence", F.lit(0.0)) > CLASS_LIMIT)
    odd_words = (F.col("n_words") >= WORD_WORDS) & (F.coalesce("word_divergence", F.lit(0.0)) > WORD_LIMIT)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd_letters & ~odd_words).alias("kept"), "class_divergence", "word_divergence",
    )


def op9(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)
