"""Filter interaction audit with decision diagrams.

Which documents a filter removes depends on the filters before it. Each document
becomes a mask of the filters it fails; Spark counts masks for each part (a value of
``lang``), so what is left of a part is at most 32 rows of counts, whatever its size. From
these a decision diagram is built: a level for each filter, at each node a branch for
documents that pass and one for those that fail, and at each node the counts
of the documents below. Swapping two adjacent levels gives the diagram of another
order of filters and touches the nodes of these two levels only; all orders follow from
one by such swaps. The path of passing branches through an order's diagram is
the run of its filters: what passes a node is kept, what branches off is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
SYMBOLS = "[#$%&*|]"
WEIGHTS = ("n", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


class Diagram:
    """An ordered decision diagram over ``size`` variables whose leaves are weights; equal nodes are one.

    A node is (weight, pass, fail), weight the sum below it; a leaf has no branches. The node 0 is empty
    and stands for any diagram without weight, so only what occurs takes room.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], size: int, width: int):
        self.size = size
        self.order = list(range(size))
        self.nodes: list[tuple] = [((0,) * width, 0, 0)]
        self.known: dict[tuple, int] = {}
        level = {mask: self._node(w, -1, -1) for mask, w in weights.items()}
        for var in reversed(range(size)):  # masks without the bits of the variables below
            rest = {m & ~(1 << var) for m in level}
            level = {m: self._join(level.get(m, 0), level.get(m | 1 << var, 0)) for m in rest}
        self.root = level.get(0, 0)

    def _node(self, weight: tuple, passed: int, failed: int) -> int:
        if not any(weight):
            return 0
        key = (weight, passed, failed) if passed < 0 else (passed, failed)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append((weight, passed, failed))
        return self.known[key]

    def _join(self, passed: int, failed: int) -> int:
        weight = tuple(a + b for a, b in zip(self.nodes[passed][0], self.nodes[failed][0]))
        return self._node(weight, passed, failed)

    def swap(self, level: int) -> None:
        """Exchange the variables of two adjacent levels; nodes below them stay as they are."""
        done: dict[int, int] = {0: 0}

        def at(node: int, depth: int) -> int:
            if node not in done:
                _, passed, failed = self.nodes[node]
                if depth < level:
                    done[node] = self._join(at(passed, depth + 1), at(failed, depth + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = self.nodes[passed], self.nodes[failed]
                    done[node] = self._join(self._join(pp, fp), self._join(pf, ff))
            return done[node]

        self.root = at(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[tuple, tuple]]:
        """(kept, removed) weights of each step of the present order."""
        out, node = [], self.root
        for _ in range(self.size):
            _, passed, failed = self.nodes[node]
            out.append((self.nodes[passed][0], self.nodes[failed][0]))
            node = passed
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, lead through all orders of n variables."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:  # the last variable wanders through an order of the others, then these change once
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def audit_part(masks: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """Rows (filter_order, step, ...) as in SCHEMA for the counts (n, good, toxic) of one part's failure masks."""
    diagram = Diagram(masks, len(filters), len(WEIGHTS))
    runs = {tuple(diagram.order): diagram.path()}
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        runs[tuple(diagram.order)] = diagram.path()
    fails, alone, share = {}, {}, dict.fromkeys(range(len(filters)), 0)
    for order, steps in runs.items():
        fails[order[0]] = steps[0][1][0]  # nothing was removed before
        alone[order[-1]] = steps[-1][1][0]  # everything else has passed
        for var, (_, removed) in zip(order, steps):
            share[var] += removed[0]
    return [
        ("".join(filters[v] for v in order), k + 1, kept[0], gone[0], fails[v] - gone[0], alone[v], gone[1], gone[2], share[v])
        for order, steps in sorted(runs.items())
        for k, (v, (kept, gone)) in enumerate(zip(order, steps))
    ]


def failure_mask(text: Column, words: Column) -> Column:
    """Bits 0 to 3 for the filters A to D; ``words`` are the text's words."""
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * upper > MOST_UPPER * F.length(text),
        text.rlike(SYMBOLS),
    )
    mask = F.lit(0)
    for bit, failed in enumerate(conditions):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each failure mask, with quality=1 and with toxic=1 labels.

    Copies are told by a digest, and counted before they meet: a text that a third of
    the documents share is a few rows. A row without an id has no smaller one and makes none
    fail; rows that repeat an id are all the first of their text or none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
    ).withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
    rows = rows.select(
        "part", "doc_id", failure_mask(F.col("text"), F.col("words")).cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    rows = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)  # rows without an id do not gather in one task
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marks = marks.withColumn("salt", F.lit(0).cast("long"))
    rows = rows.withColumn("salt", salt).join(marks, ["doc_id", "salt"], "left")
    kinds = rows.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    # a digest has one row for each part and label here
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("pass", F.col("free") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("pass").alias("n")),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("pass")).alias("n")),
    )).alias("s")
    counts = kinds.select("part", "good", "toxic", split).select("part", "good", "toxic", "s.mask", "s.n")
    lost = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters, and step; see SCHEMA.

    A null text is empty, a null ``lang`` the empty part. Repeated rows count each on its own;
    an id labelled more than once has a label that any of its rows has. A document table
    without rows gives none. Columns other than doc_id, text, lang, quality and toxic are not read.
    """
    counts = mask_counts(docs, labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("masks"))  # at most 32 a part
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def work(batches):
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audit_part({m["mask"]: tuple(m[w] for w in WEIGHTS) for m in masks})
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                cols = [[part] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return parts.mapInArrow(work, SCHEMA)


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


#: The query by running every order over the counts of all masks.
OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
  + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(w.doc_id > least, false)::INT AS mask
  FROM w JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
  WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM orders, range(1, 6) r(i)),
runs AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM runs
"""
