"""Removal of repeated byte strings with suffix arrays built in linear steps.

``lyndon_suffix_array`` sorts suffixes without recursion or renaming: suffixes
are grouped by the Lyndon word they start with, groups are processed from the
highest down, each extending the groups of its previous smaller suffixes, and the
order inside the groups is then emitted from left to right along the same pointers.

A string of ``length`` bytes can repeat anywhere in the table, so texts are first cut
into contexts that have to meet: every window of ``length`` bytes picks its least
k-gram by hash (its anchor); equal windows pick equal anchors at equal places.
Windows with one anchor are neighbours, so one row stands for all of them:
(anchor hash, hash of their bytes). Counting those rows settles most: an anchor
seen once has no repeated window, contexts seen twice are repeated whole. Only
different contexts of one anchor are left; these texts, in blocks of whole
anchors, go through the suffix array, which gives the repeated windows exactly.
Anchors with more than ``hot`` different contexts are not gathered in one task:
their windows are counted one by one, with partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import raw_bytes, row_spans, tidy
from plumbline.llm.order import order_key
from plumbline.session import settle

LENGTH = 200
GRAM = 64
HOT = 5_000
CHUNK = 1 << 18  # bytes of texts that a task looks at together; about 150 bytes of memory for each
BLOCK_TOKENS = 60_000
BATCH_BYTES = 4_000_000
UNSET = -2
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def lyndon_suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; symbols are dense ranks from 0."""
    n = len(text)
    if not n:
        return []
    k = max(text) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, c in enumerate(text):
        members[c].append(i)
    group, size = list(text), [len(m) for m in members]
    below, above = list(range(-1, k - 1)), [*range(1, k), -1]
    smaller = [UNSET] * n  # the previous smaller suffix, known once its group is processed
    done = []

    def lift(h: int, those: list[int]) -> None:
        """Part ``those`` from group h as a new group just above it, unless they are all of h."""
        if len(those) == size[h]:
            return
        new = len(size)
        size[h] -= len(those)
        size.append(len(those))
        members.append(those)
        for p in those:
            group[p] = new
        up = above[h]
        above.append(up)
        below.append(h)
        above[h] = new
        if up >= 0:
            below[up] = new

    g = k - 1
    while g >= 0:
        if size[g] == 1 and len(members[g]) == 1:
            i = members[g][0]
            p = i - 1
            while p >= 0 and smaller[p] != UNSET:
                p = smaller[p]
            smaller[i] = p
            done.append(g)
            if p >= 0:
                lift(group[p], [p])
        elif size[g]:
            here = [i for i in members[g] if group[i] == g]
            here.sort()
            members[g] = here
            times: dict[int, int] = {}
            for i in here:
                p = i - 1
                while p >= 0 and smaller[p] != UNSET:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            done.append(g)
            parts: dict[tuple[int, int], list[int]] = {}
            for p, c in times.items():
                parts.setdefault((-c, group[p]), []).append(p)
            for c, h in sorted(parts):  # followed by more copies of this group: higher
                lift(h, parts[c, h])
        g = below[g]

    slot, at = [0] * len(size), 0
    for g in reversed(done):
        slot[g] = at
        at += size[g]
    order = [0] * n
    p = n - 1
    for j in range(-1, n):
        if j >= 0:
            p = order[j] - 1
        while p >= 0 and group[p] >= 0:
            g = group[p]
            order[slot[g]] = p
            slot[g] += 1
            group[p] = -1
            p = smaller[p]
    return order


class Rolling:
    """Hashes of any byte range of a buffer from prefix sums of powers."""

    def __init__(self):
        self.value = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.empty(0, np.uint64)

    def load(self, buf: np.ndarray) -> None:
        n = len(buf)
        if len(self.up) < n + 1:
            size = n + 1
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, np.uint64(BASE))])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, np.uint64(BASE_INVERSE))])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[buf] * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start] + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks."""
    n = len(key) - width + 1
    padded = np.r_[key, np.full(-len(key) % width, np.iinfo(key.dtype).max, key.dtype)].reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(roll: Rolling, buf: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Contexts of a buffer of texts: (anchor, content hash, text number, first window in the text, windows, anchor's place)."""
    width = length - gram + 1
    n = len(buf)
    roll.load(buf)
    at = np.arange(n - gram + 1)
    grams = roll.of(at, at + gram)
    least = least_in_windows((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), width)
    pick = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    s = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    pick = pick[s]
    new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (text[s[1:]] != text[s[:-1]])])
    first, last, anchor = s[new], s[np.r_[new[1:] - 1, len(s) - 1]], pick[new]
    content = roll.of(first, last + length, anchor - first)
    owner = text[first]
    return grams[anchor], content, owner, first - starts[owner], last - first + 1, anchor - first


def repeated_windows(contexts: list[tuple[bytes, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(context, first window, last window) of the runs of windows that occur more than once.

    A context is (bytes, the anchor's place, windows). Its bytes become 8-byte
    symbols counted from the anchor, so equal windows are cut alike. The suffix
    array and the bytes that neighbours share give the classes of suffixes that
    agree in the ``length - x`` bytes from a symbol on; among those, a window that
    starts x bytes earlier is repeated if the x bytes before agree as well.
    """
    fronts = [-a % 8 for _, a, _ in contexts]
    padded = [b"\0" * f + c + b"\0" * (-(f + len(c)) % 8) for (c, _, _), f in zip(contexts, fronts)]
    symbols = np.frombuffer(b"".join(padded), ">u8").astype(np.uint64)
    n = len(symbols)
    _, ranks = np.unique(symbols, return_inverse=True)
    order = np.array(lyndon_suffix_array(ranks.tolist()))

    need = -(-length // 8) + 1
    shared = np.zeros(n, np.int64)  # bytes shared with the suffix before, up to the need
    live = np.arange(1, n)
    for k in range(need):
        a, b = order[live] + k, order[live - 1] + k
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        differ = symbols[a] ^ symbols[b]
        same = differ == 0
        top = differ[~same]
        high = np.zeros(len(top), np.int64)
        for cut in range(1, 8):
            high += top < (np.uint64(1) << np.uint64(64 - 8 * cut))
        shared[live] += 8
        shared[live[~same]] += high - 8
        live = live[same]

    counts = np.array([len(p) // 8 for p in padded])
    owner = np.repeat(np.arange(len(contexts)), counts)
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    offset = 8 * (np.arange(n) - begin[owner]) - np.array(fronts)[owner]
    windows = np.array([w for _, _, w in contexts])
    first = np.r_[0, np.cumsum(windows)]
    marked = np.zeros(first[-1], bool)
    before = np.r_[np.uint64(0), symbols[:-1]]
    for x in range(8):
        klass = np.cumsum(shared < length - x)
        start = offset[order] - x
        ok = (start >= 0) & (start < windows[owner[order]])
        which, klass = order[ok], klass[ok]
        left = before[which] & np.uint64((1 << (8 * x)) - 1)
        by = np.lexsort((left, klass))
        same = (klass[by][1:] == klass[by][:-1]) & (left[by][1:] == left[by][:-1])
        hit = np.zeros(len(by), bool)
        hit[1:] |= same
        hit[:-1] |= same
        got = which[by[hit]]
        marked[first[owner[got]] + offset[got] - x] = True

    at = np.flatnonzero(marked)
    if not len(at):
        return []
    of = np.searchsorted(first, at, side="right") - 1
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
    end = np.r_[new[1:] - 1, len(at) - 1]
    return list(zip(of[new].tolist(), (at[new] - first[of[new]]).tolist(), (at[end] - first[of[end]]).tolist()))


# A context's place is one number: first window, number of windows, anchor's place.
def _place(first, windows, anchor):
    return first << 16 | windows << 8 | anchor


LO, WINDOWS, ANCHOR = "shiftright(place, 16)", "(shiftright(place, 8) & 255)", "(place & 255)"


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, d, place, _id, _key, times) of every context of ``texts`` (_id, _key, text).

    Of contexts that are alike within a chunk the first has ``times`` 2 and stands for the
    others, which have 0: they are known to repeat and need not meet anything.
    """
    names = ["a", "d", "place", "_id", "_key", "times"]

    def work(batches):
        roll = Rolling()
        for batch in batches:
            ids, keys = (np.asarray(batch.column(i)) for i in (0, 1))
            buf, starts = raw_bytes(batch.column(2))
            for i, j in row_spans(starts, CHUNK):
                part = buf[starts[i] : starts[j]]
                if len(part) < length:
                    continue
                a, d, text, first, windows, anchor = find_anchors(roll, part, starts[i : j + 1] - starts[i], length, gram)
                by = np.lexsort((d, a))
                new = np.r_[True, (a[by][1:] != a[by][:-1]) | (d[by][1:] != d[by][:-1])]
                times = np.zeros(len(a), np.int64)
                times[by[new]] = np.minimum(2, np.diff(np.r_[np.flatnonzero(new), len(a)]))
                cols = [a.view(np.int64), d.view(np.int64), _place(first, windows, anchor), ids[i:j][text], keys[i:j][text], times]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        tidy()

    return texts.filter(F.octet_length("text") >= length).select("_id", "_key", "text").mapInArrow(
        work, ", ".join(f"{n} long" for n in names)
    )


def _slices(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts (a, place, _id, _key, n), cut from their texts: a text travels once for all of its contexts."""
    names = ["a", "place", "n", "_id", "_key", "bytes"]
    schema = pa.schema([(x, pa.int64()) for x in names[:-1]] + [("bytes", pa.binary())])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            ids, keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            at = np.asarray(lists.offsets)
            fields = [np.asarray(lists.values.field(k)) for k in range(3)]
            buf, starts = raw_bytes(batch.column(3))
            for i, (doc, key) in enumerate(zip(ids, keys)):
                for a, place, n in zip(*(f[at[i] : at[i + 1]].tolist() for f in fields)):
                    begin = starts[i] + (place >> 16)
                    cut = buf[begin : begin + (place >> 8 & 255) - 1 + length].tobytes()
                    held.append((a, place, n, doc, key, cut))
                    size += len(cut) + 60
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
        tidy()

    # all columns of the texts, so that this join and the last one share one shuffle of them
    rest = [c for c in texts.columns if c not in ("_id", "_key", "text")]
    gathered = wanted.groupBy("_id", "_key").agg(F.collect_list(F.struct("a", "place", "n")).alias("_wanted"))  # no more than the text has
    joined = gathered.join(texts, ["_id", "_key"]).select("_id", "_key", "_wanted", "text", *rest)
    return joined.mapInArrow(work, "a long, place long, n long, _id long, _key long, bytes binary")


def _by_suffixes(slices: DataFrame, length: int, block_tokens: int) -> DataFrame:
    """Repeated ranges (_id, _key, span) of contexts seen once, by suffix arrays over blocks of whole anchors."""
    schema = pa.schema([("_id", pa.int64()), ("_key", pa.int64()), ("span", pa.int64())])

    def solve(block):
        got = repeated_windows([(c, p & 255, p >> 8 & 255) for _, p, _, _, _, c in block], length)
        out = []
        for of, s, e in got:
            _, place, n, doc, key, _ = block[of]
            if n == 1:  # the others are known to be repeated whole
                out.append((doc, key, (place >> 16) + s << 16 | e - s + length))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    def work(batches):
        block, group, tokens, last = [], [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[0] != last:
                    block += group
                    group, last = [], row[0]
                    if tokens >= block_tokens:
                        yield from solve(block)
                        block, tokens = [], 0
                group.append(row)
                tokens += len(row[5]) // 8 + 2
        if block or group:
            yield from solve(block + group)
        tidy()

    parts = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        slices.select("a", "place", "n", "_id", "_key", "bytes")
        .repartition(parts, "a").sortWithinPartitions("a")
        .mapInArrow(work, "_id long, _key long, span long")
    )


def _by_counting(slices: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: every window is a row, counted with partial sums."""
    names = ["a", "h1", "h2", "n", "_id", "_key", "at"]

    def work(batches):
        one, two = Rolling(), Rolling()
        two.value = np.random.default_rng(12).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            a, place, n, doc, key = (np.asarray(batch.column(i)) for i in range(5))
            buf, starts = raw_bytes(batch.column(5))
            windows = place >> 8 & 255
            for i, j in row_spans(starts, CHUNK // 4):
                row = np.repeat(np.arange(i, j), windows[i:j])
                begin = np.cumsum(windows[i:j]) - windows[i:j]
                at = np.arange(len(row)) - begin[row - i]
                part, s = buf[starts[i] : starts[j]], starts[row] - starts[i] + at
                one.load(part)
                two.load(part)
                cols = [a[row], one.of(s, s + length).view(np.int64), two.of(s, s + length).view(np.int64), n[row], doc[row], key[row], (place[row] >> 16) + at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    rows = slices.select("a", "place", "n", "_id", "_key", "bytes").mapInArrow(work, ", ".join(f"{x} long" for x in names))
    often = rows.groupBy("a", "h1", "h2").agg(F.sum("n").alias("times")).filter("times > 1").select("a", "h1", "h2")
    return rows.filter("n = 1").join(often, ["a", "h1", "h2"]).select(
        "_id", "_key", F.expr(f"shiftleft(at, 16) | {length}").alias("span")
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_tokens: int = BLOCK_TOKENS,
    carry: list[str] = (),
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, was_null, and a struct ``_carry`` of the ``carry`` columns.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else
    in the table goes; strings are judged on the input. A null text is empty; a
    text shorter than ``length`` stays. Repeated rows repeat each other, so they go.
    Rows without an id are told apart by their text. An empty table gives no
    rows. Columns other than doc_id, text and ``carry`` are not read. ``kept_text`` is
    what is left as text, without the pieces of characters that a cut breaks; the sizes
    and the hash are those of the bytes.
    """
    if not 2 <= length - gram + 1 <= 255:
        raise ValueError("length - gram must lie between 1 and 254")
    raw = F.coalesce(F.col("text"), F.lit(""))
    # where ids repeat, a row is told by its text as well
    ids = docs.select(order_key().alias("_id"))
    unique = ids.groupBy("_id").count().filter("count > 1").isEmpty()
    texts = docs.select(
        order_key().alias("_id"), (F.lit(0).cast("long") if unique else F.xxhash64(raw)).alias("_key"),
        F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"), F.col("text").isNull().alias("was_null"),
        *([F.struct(*carry).alias("_carry")] if carry else []),
    )
    every = _contexts(texts, length, gram)
    anchors = every.filter("times > 0").groupBy("a").agg(F.sum("times").alias("all"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    anchors = anchors.filter("all > 1").select(F.col("a").alias("_meet"), "lo", "hi")
    # contexts that need not meet are dealt evenly, whatever their anchor
    meet = F.when(F.col("times") > 0, F.col("a")).otherwise(F.xxhash64("_id", "_key", "place"))
    met = every.withColumn("_meet", meet).join(anchors, "_meet", "left").filter("times = 0 or lo is not null")
    mixed = ((F.col("times") > 0) & (F.col("lo") < F.col("hi"))).alias("mixed")
    # about a third of the contexts is left; stored, so that the texts are read twice up to here and not for each use
    seen = settle(met.select("a", "d", "place", "_id", "_key", "times", mixed))
    span = F.expr(f"shiftleft({LO}, 16) | ({WINDOWS} + {length - 1})").alias("span")
    alike = seen.filter("not mixed").select("_id", "_key", span)
    several = seen.filter("mixed")
    kinds = several.groupBy("a", "d").agg(F.sum("times").alias("n"), F.min(F.struct("_id", "_key", "place")).alias("one"))
    kinds = settle(kinds.select("a", "d", "n", "one.place", "one._id", "one._key"))
    whole = several.join(kinds.filter("n > 1").select("a", "d"), ["a", "d"]).select("_id", "_key", span)
    per_anchor = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"))
    wanted = kinds.join(per_anchor, "a").select("a", "d", "place", "_id", "_key", "n", "kinds")
    few = _slices(wanted.filter(F.col("kinds") <= hot), texts, length)
    many = _slices(wanted.filter(F.col("kinds") > hot), texts, length)
    spans = alike.unionByName(whole).unionByName(_by_suffixes(few, length, block_tokens)).unionByName(_by_counting(many, length))
    by_text = spans.groupBy("_id", "_key").agg(F.collect_set("span").alias("spans"))
    return _cut(texts.join(by_text, ["_id", "_key"], "left"), carry)


def _cut(joined: DataFrame, carry: list[str]) -> DataFrame:
    frame = joined.select("doc_id", "text", "spans", "was_null", *(["_carry"] if carry else []))
    made = [("doc_id", "long", pa.int64()), ("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()),
            ("kept_sha256", "string", pa.string()), ("kept_text", "string", pa.string())]
    out = frame.drop("doc_id", "text", "spans").schema
    for k, (name, kind, _) in enumerate(made):
        out = type(out)([*out.fields[:k], *type(out)().add(name, kind).fields, *out.fields[k:]])

    def work(batches):
        for batch in batches:
            buf, starts = raw_bytes(batch.column(1))
            rows = []
            for i, (doc, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                text = buf[starts[i] : starts[i + 1]]
                n = len(text)
                if not spans.is_valid:
                    left, gone, runs = text.tobytes(), 0, 0
                else:
                    s = spans.values.to_numpy()
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, s >> 16, 1)
                    np.add.at(edge, (s >> 16) + (s & 0xFFFF), -1)
                    off = np.cumsum(edge[:-1]) > 0
                    left, gone = text[~off].tobytes(), int(off.sum())
                    runs = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                rows.append((doc, n, gone, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*rows)) or [()] * len(made)
            arrays = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, made)]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], [*[m[0] for m in made], *batch.schema.names[3:]])
        tidy()

    return frame.mapInArrow(work, out)


def op4(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
