"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a line, or a sentence of it) is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors, each word modulo
2**60. Order does not matter; a paragraph is inserted or deleted by adding or
subtracting its vector (``add``, ``subtract``); equal multisets have equal sums.

The vector has 2 words that are hashes as they stand (equality), 1 word that is
1 (the count), and 64 words that each hold 2 hash bits in fields of 30 bits. The
fields' sums are counts per hash bit; less half the paragraphs they are a random
sign sketch of the multiset, so likeness 2ab/(aa+bb) comes from two fingerprints
alone. A field holds counts below 2**30, more paragraphs than a string has room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.order import key_cuts, order_key, piece_of

WORD = 60
MASK = 2**WORD - 1
FIELD = 30
FIELDS = WORD // FIELD
STRIDE = 64 // FIELDS
EQUAL = 2
HASHES = 2
LANES = 64 * HASHES
WORDS = EQUAL + 1 + LANES // FIELDS
PARTS = r"\n|(?<=[.!?])[ \t]+"


def _bits(h: Column, k: int) -> Column:
    """Hash bits k and k+32, one in each field."""
    out = F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1))
    for i in range(1, FIELDS):
        out = out + F.shiftleft(F.shiftrightunsigned(h, k + STRIDE * i).bitwiseAND(F.lit(1)), FIELD * i)
    return out


def paragraph_vector(part: Column) -> Column:
    words = [F.xxhash64(F.lit(100 + i), part).bitwiseAND(F.lit(MASK)) for i in range(EQUAL)]
    words.append(F.lit(1).cast("long"))
    spread = F.flatten(
        F.transform(
            F.array(*[F.xxhash64(F.lit(200 + i), part) for i in range(HASHES)]),
            lambda h: F.array(*[_bits(h, k) for k in range(STRIDE)]),
        )
    )
    return F.concat(F.array(*words), spread)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def vector(text: Column) -> Column:
    """The sum over the text's paragraphs; blank ones do not count. No paragraph: zeros."""
    parts = F.filter(F.split(text, PARTS), lambda p: F.length(F.trim(p)) > 0)
    zero = F.array_repeat(F.lit(0).cast("long"), WORDS)
    return F.aggregate(parts, zero, lambda acc, p: add(acc, paragraph_vector(p)))


def fingerprint(vec: Column, text: Column) -> Column:
    """Fixed-width hex of the vector. A text of blanks only has no paragraph; its hash stands in for the equality words."""
    hexed = F.array_join(F.transform(vec, lambda w: F.lpad(F.lower(F.hex(w)), WORD // 4, "0")), "")
    blank = F.concat(F.lit("-"), F.lower(F.hex(F.xxhash64(F.lit(300), text))))
    return F.when((F.element_at(vec, EQUAL + 1) == 0) & (text != ""), F.concat(hexed, blank)).otherwise(hexed)


def _lanes(vec: Column) -> Column:
    """Signed sums: twice the count of set bits less the number of paragraphs, per hash bit."""
    n = F.element_at(vec, EQUAL + 1)
    return F.flatten(
        F.transform(
            F.slice(vec, EQUAL + 2, LANES // FIELDS),
            lambda w: F.transform(
                F.lit([FIELD * i for i in range(FIELDS)]).cast("array<int>"),
                lambda at: F.lit(2).cast("long")
                * F.call_function("shiftrightunsigned", w, at).bitwiseAND(F.lit(2**FIELD - 1)) - n,
            ),
        )
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two vectors: 1 for equal ones, about the shared share of paragraphs otherwise."""
    def ratio(x: Column, y: Column) -> Column:
        total = _dot(x, x) + _dot(y, y)
        return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _dot(x, y) / total)))

    # the lanes are bound to a lambda's variable, else each use would unpack them again
    pair = F.array(F.struct(_lanes(a).alias("x"), _lanes(b).alias("y")))
    return F.when(a == b, 1.0).otherwise(F.element_at(F.transform(pair, lambda p: ratio(p["x"], p["y"])), 1))


def with_next(docs: DataFrame, key: str, ties: list[str], bring: dict[str, str]) -> DataFrame:
    """Add columns of the following row by (key, ties), of the first row for the last one.

    ``bring`` maps new names to columns. Rows move once, to a task per range of
    keys; the first rows of each range are copied to the range before it.
    """
    cuts = key_cuts(docs, key)
    if not cuts:
        return docs.withColumns({new: F.col(old) for new, old in bring.items()})
    cut = docs.withColumn("_piece", piece_of(F.col(key), cuts)).withColumn("_copy", F.lit(0))
    heads = (
        docs.filter(F.col(key).isin(cuts))
        .withColumn("_piece", F.pmod(piece_of(F.col(key), cuts) - 1, F.lit(len(cuts))))
        .withColumn("_copy", F.lit(1))
    )
    w = Window.partitionBy("_piece").orderBy("_copy", key, *ties)
    both = cut.unionByName(heads)
    return (
        both.withColumns({new: F.lead(old).over(w) for new, old in bring.items()})
        .filter("_copy = 0").drop("_piece", "_copy")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    The edit replaces the last quarter of the code points by as many from the
    start of the next text by doc_id (equal ids: by text hash; null ids first).
    A null text counts as empty; a table of one row is its own next. Repeated
    rows each give a row; an empty table gives none; other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), order_key().alias("_key"), raw.alias("text"),
    ).withColumn("_tie", F.xxhash64("text")).withColumn("vec", vector(F.col("text")))
    after = with_next(base, "_key", ["_tie"], {"next_text": "text", "next_vec": "vec"})
    n = F.char_length("text")
    edited = (
        after.withColumn("n_chars", n.cast("long"))
        .withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
        .withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - _cut)"), F.expr("left(next_text, _cut)")))
        .withColumn("edited_vec", vector(F.col("edited")))
    )
    return edited.select(
        "doc_id", "n_chars", "edited",
        fingerprint(F.col("vec"), F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited_vec"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )


def op5(docs: DataFrame) -> DataFrame:
    return fingerprint_edits(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
