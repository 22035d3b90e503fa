"""N-gram Jaccard join as a blocked product of the document by n-gram incidence matrix.

Two documents link when their sets of word n-grams have a Jaccard similarity of
at least ``least`` percent. With sizes a and b the overlap must then reach
least*(a+b)/(100+least), so their rows differ in at most d = (a+b)*(100-least)/(100+least)
columns.

1. Rows that are equal are one row (the document with the least id).
2. The columns are dealt by hash into d+2 blocks or a few more, d for the largest sizes of a
   class of sizes. A row that links with another agrees with it in a least number of whole
   blocks (``block_signatures``), two at least, so blocks of different rows that are equal are
   memberships, and a row with fewer memberships than that links with nothing. Of the
   others as many but one may be left out, if all rows leave out those that come last in
   one order: what most rows share comes last. Rows meet where they share one that is
   left. A hash of each block travels once, packed by range; those that a task's own rows
   share are memberships there already, and one row stands for them, so a block that very many
   rows share stays small. Of the rows that meet, one is the hub of the others: as many pairs as rows.
3. Rows that met, directly or by way of others, are a cluster. The rows of a cluster that
   share a class of sizes are multiplied with each other in tasks of one or two row blocks.
   Parities of hashed columns come first: rows differ in at least as many columns as
   parities. For the pairs left overlaps are summed over slices of columns: pairs that can no
   longer reach their bound are dropped, rows that are linked already are skipped, and only links come back.
4. In a very large cluster hubs of many rows are first multiplied with the rows they met, which links
   most groups of near copies in one pass over their rows, however large they are; step 3 follows
   where several components are left.

Hubs with many rows and large clusters are dealt over several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import tidy
from plumbline.llm.graph import components
from plumbline.llm.ngrams import FACTORS, WordHashes, ascii_words, scramble, shingles
from plumbline.llm.order import number_rows
from plumbline.session import settle

WIDTH = 3
LEAST = 90
CLASS = 1.5
ROWS = 256  # rows that a hub is multiplied with at once
BLOCK_ROWS = 1024  # large clusters are counted in blocks of so many rows; a block of short rows has up to SHORT times as many
BLOCK_VALUES = 4096  # columns of a row of full length: a block holds BLOCK_ROWS of them
SHORT = 16
HUB_ROWS = 64  # in a large cluster, hubs with fewer rows do not pay for moving them
STAR_BLOCKS = 8  # clusters of more blocks are linked by hubs first
SLICE = 2048
MOST_PARITIES = 8192
MOST_BITS = 26
CHUNK_KEYS = 1_000_000  # blocks that a task sorts at once
KEPT_BYTES = 5  # of a block's hash within its range; a clash only costs a product


def size_classes(n: int, least: int) -> list[tuple[int, int]]:
    """(class, blocks) pairs in which a row of n columns takes part: its own class, and the next if a larger partner can be there."""
    own = int(math.log(n) / math.log(CLASS) + 1e-9)
    out = []
    for c in (own, own + 1):
        low, high = math.ceil(CLASS**c), math.ceil(CLASS ** (c + 1))
        if c == own or 100 * n >= least * low:
            differ = 2 * high * (100 - least) // (100 + least)  # columns in which two linked rows of the class may differ
            spare = int(2 * differ * math.exp(-high / (differ + 2)))  # twice the blocks that stay empty by chance
            out.append((c, differ + 2 + spare))
    return out


def most_differing(n: int, c: int, least: int) -> int:
    """Columns in which a row of n columns may differ from a row of class c, or of the class before, that it links with."""
    partner = min(math.ceil(CLASS ** (c + 1)), 100 * n // least)
    return (n + partner) * (100 - least) // (100 + least)


def block_signatures(row: np.ndarray, least: int) -> tuple[np.ndarray, list[int]]:
    """One number for each block of the row's columns, and the least numbers of them that a linked row shares.

    The row takes part in one or two classes of sizes, one even and one odd; the numbers of
    a class carry its parity as their lowest bit, and ``needs`` is for (even, odd). A linked row
    differs in at most ``most_differing`` blocks, so it shares the other filled ones. Where these could be
    fewer than two, blocks without any column count as well: then all but so many blocks are
    shared, or the linked row has two filled ones to spare itself.
    """
    out, needs = [], [0, 0]
    mixed = scramble(row ^ np.uint64(FACTORS[4]))
    for c, blocks in size_classes(len(row), least):
        block = ((row >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        salt = np.uint64(c * FACTORS[1] & 0xFFFFFFFFFFFFFFFF)
        sums = np.add.reduceat(mixed, start)
        made = [scramble(sums + block[start].astype(np.uint64) * np.uint64(FACTORS[0]) + salt)]
        needs[c & 1] = len(start) - most_differing(len(row), c, least)
        if needs[c & 1] < 2:
            empty = np.setdiff1d(np.arange(blocks), block[start]).astype(np.uint64)
            made.append(scramble(empty * np.uint64(FACTORS[2]) + salt))
            needs[c & 1] = 2
        out += [m & ~np.uint64(1) | np.uint64(c & 1) for m in made]
    return np.concatenate(out), needs


def parities(rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Parities of how many of a row's columns fall on each of ``bits`` places, a power of two."""
    at = np.repeat(np.arange(len(rows)) * bits, [len(r) for r in rows])
    place = (np.concatenate(rows) & np.uint64(bits - 1)).astype(np.int64)
    return (np.bincount(at + place, minlength=len(rows) * bits) & 1).reshape(len(rows), bits).astype(np.float32)


def linked(left: list[np.ndarray], right: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of rows that link: the product of two row blocks, summed over slices of columns."""
    a, b = (np.array([len(r) for r in rows]) for rows in (left, right))
    need = -(-least * (a[:, None] + b[None, :]) // (100 + least))
    alive = np.minimum(a[:, None], b[None, :]) >= need
    if not alive.any():
        return []
    bits = min(MOST_PARITIES, max(256, 1 << int(max(a.max(), b.max()) - 1).bit_length()))
    p, q = parities(left, bits), parities(right, bits)
    alive &= p.sum(1)[:, None] + q.sum(1)[None, :] - 2 * (p @ q.T) <= a[:, None] + b[None, :] - 2 * need
    if not alive.any():
        return []
    at_left, at_right = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    alive, need = alive[np.ix_(at_left, at_right)], need[np.ix_(at_left, at_right)]
    live = [[left[i] for i in at_left], [right[j] for j in at_right]]
    shared = np.intersect1d(*(np.unique(np.concatenate(rows)) for rows in live), assume_unique=True)
    sides, to_come = [], []
    for rows in live:  # entries in shared columns, by column
        row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        at = np.minimum(np.searchsorted(shared, column), max(0, len(shared) - 1))
        held = shared[at] == column if len(shared) else np.zeros(len(column), bool)
        row, at = row[held], at[held]
        by = np.argsort(at, kind="stable")
        sides.append((row[by], at[by]))
        to_come.append(np.bincount(row, minlength=len(rows)))
    overlap = np.zeros(need.shape, np.float32)
    for k in range(0, len(shared), SLICE):
        dense = []
        for (row, at), rest in zip(sides, to_come):
            lo, hi = np.searchsorted(at, (k, k + SLICE))
            d = np.zeros((len(rest), min(SLICE, len(shared) - k)), np.float32)
            d[row[lo:hi], at[lo:hi] - k] = 1
            rest -= np.bincount(row[lo:hi], minlength=len(rest))
            dense.append(d)
        overlap += dense[0] @ dense[1].T
        alive &= overlap + np.minimum(to_come[0][:, None], to_come[1][None, :]) >= need
        if not alive.any():
            return []
    i, j = np.nonzero(alive & (overlap >= need))
    return list(zip(at_left[i].tolist(), at_right[j].tolist()))


def _rows(batches, width: int):
    hashes = WordHashes()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc, shingles(hashes.of(ascii_words(text.as_py() or "")), width)


def _batches(rows, schema: pa.Schema, size: int = 2000, values: int = 1_000_000):
    """Arrow batches of rows, by count and by the length of their last value."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1]) if hasattr(row[-1], "__len__") else 1
        if len(held) >= size or total >= values:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _table(docs: DataFrame, width: int) -> DataFrame:
    """(_id, n, node): the size of the document's set and a hash of the whole set."""
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])

    def rows(batches):
        for doc, row in _rows(batches, width):
            if not len(row):
                yield doc, 0, 0
            else:
                total = np.add.reduceat(scramble(row + np.uint64(FACTORS[3])), [0]) + np.uint64(len(row))
                yield doc, len(row), int(scramble(total).view(np.int64)[0])

    return docs.mapInArrow(lambda batches: _batches(rows(batches), schema), "_id long, n long, node long")


def _deltas(ids: np.ndarray) -> bytes:
    """Ascending ids as their first and the steps, in as few bytes as the largest step needs."""
    steps = np.diff(ids)
    wide = int(steps.max()) if len(steps) else 0
    size = next(w for w in (1, 2, 4, 8) if wide < 1 << (8 * w - 1) or w == 8)
    return bytes([size]) + ids[:1].tobytes() + steps.astype(f"<i{size}" if size == 8 else f"<u{size}").tobytes()


def _undeltas(raw: bytes) -> np.ndarray:
    size = raw[0]
    steps = np.frombuffer(raw, f"<i{size}" if size == 8 else f"<u{size}", offset=9).astype(np.int64)
    return np.cumsum(np.r_[np.frombuffer(raw[1:9], np.int64), steps])


SINGLE, KNOWN, MET, NEEDS = range(4)  # what a packed row holds
LOW_BITS = 8 * KEPT_BYTES


def _memberships(docs: DataFrame, reps: DataFrame, width: int, least: int) -> DataFrame:
    """(_id, keys, even, odd): the blocks that a row shares with another one, and its needs, of the rows ``reps`` (_id).

    Copies of a row may take part; they only make keys look shared that are not.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    slot, likely = _likely_filter(reps, 16)
    schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def deal(signatures, owners, needs):
        docs_of = np.array(owners, np.int64)
        key, ids = np.concatenate(signatures), np.repeat(docs_of, [len(s) for s in signatures])
        place = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        key = key & np.uint64((1 << LOW_BITS) - 1)
        by = np.lexsort((ids, key, place))
        key, ids, place = key[by], ids[by], place[by]
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        times = np.diff(np.r_[head, len(key)])
        spread = int(ids[0] % ranges)
        rows = [(spread, NEEDS, np.array(needs, np.int64).tobytes(), docs_of.tobytes())]
        met = np.repeat(times > 1, times)
        if met.any():
            whole = place[met] << LOW_BITS | key[met].astype(np.int64)
            rows.append((spread, MET, whole.tobytes(), ids[met].tobytes()))
        for kind, at in ((SINGLE, head[times == 1]), (KNOWN, head[times > 1])):
            if len(at):
                at = at[np.lexsort((ids[at], place[at]))]
                low = np.ascontiguousarray(key[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES])
                edge = np.flatnonzero(np.r_[True, place[at][1:] != place[at][:-1], True]).tolist()
                for a, b in zip(edge, edge[1:]):
                    rows.append((int(place[at[a]]), kind, low[a:b].tobytes(), b"" if kind == KNOWN else _deltas(ids[at[a:b]])))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def scatter(batches):
        signatures, owners, needs, held = [], [], [], 0
        for doc, row in _rows(likely(batches), width):
            if len(row):
                made, (even, odd) = block_signatures(row, least)
                signatures.append(made)
                owners.append(doc)
                needs.append(even | odd << 32)
                held += len(made)
                if held >= CHUNK_KEYS:
                    yield deal(signatures, owners, needs)
                    signatures, owners, needs, held = [], [], [], 0
        if held:
            yield deal(signatures, owners, needs)
        tidy()

    def meet(batches):
        names = ["key", "_id", "needs"]

        def out(keys, ids, needs=None):
            none = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([none if keys is None else pa.array(keys), pa.array(ids), none if needs is None else pa.array(needs)], names)

        def close(place, keys, ids, known):
            if keys:
                each = [np.frombuffer(b"".join(k), np.uint8).reshape(-1, KEPT_BYTES) for k in (keys, known)]
                wide = np.zeros((sum(map(len, each)), 8), np.uint8)
                wide[:, :KEPT_BYTES] = np.concatenate(each)
                key = wide.view("<u8").ravel()
                _, where, times = np.unique(key, return_inverse=True, return_counts=True)
                n = len(each[0])
                shared = times[where[:n]] > 1
                if shared.any():
                    yield out(place << LOW_BITS | key[:n][shared].astype(np.int64), np.concatenate(ids)[shared])

        last, keys, ids, known = None, [], [], []
        for batch in batches:
            for place, kind, packed, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place != last:
                    yield from close(last, keys, ids, known)
                    last, keys, ids, known = place, [], [], []
                if kind == SINGLE:
                    keys.append(packed)
                    ids.append(_undeltas(raw))
                elif kind == KNOWN:
                    known.append(packed)
                else:
                    values, owners = np.frombuffer(packed, np.int64), np.frombuffer(raw, np.int64)
                    yield out(values, owners) if kind == MET else out(None, owners, values)
        yield from close(last, keys, ids, known)
        tidy()

    packed = docs.select("_id", "text", slot).mapInArrow(scatter, "range int, kind int, keys binary, ids binary")
    placed = packed.repartition(parts, "range").sortWithinPartitions("range")
    met = placed.mapInArrow(meet, "key long, _id long, needs long")
    rows = met.join(reps.select("_id"), "_id", "left_semi").groupBy("_id").agg(F.collect_list("key").alias("keys"), F.max("needs").alias("needs"))
    return rows.filter(F.size("keys") > 0).select(
        "_id", "keys", F.expr(f"cast(needs & {2**32 - 1}L as int)").alias("even"), F.expr("cast(shiftright(needs, 32) as int)").alias("odd")
    )


def _meetings(docs: DataFrame, reps: DataFrame, width: int, least: int) -> DataFrame:
    """Distinct (hub, _id), hub < _id, of rows ``reps`` (_id) that share enough blocks: a star for each block that several keep."""
    rows = _memberships(docs, reps, width, least)
    enough = [
        F.expr(f"if(size(filter(keys, k -> (k & 1) = {bit})) >= {need}, transform(filter(keys, k -> (k & 1) = {bit}), k -> named_struct('key', k, 'need', {need})), null)")
        for bit, need in ((0, "even"), (1, "odd"))
    ]
    none = F.array().cast("array<struct<key:bigint,need:int>>")
    kept = rows.select("_id", F.explode(F.concat(*[F.coalesce(e, none) for e in enough])).alias("k"))
    kept = settle(kept.select("_id", "k.key", "k.need"))
    often = kept.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    # the last need - 1 by (times, key) may be left out: a linked row shares need of them, so one that both keep
    ordered = kept.join(often, "key").groupBy("_id", "need", F.expr("key & 1").alias("bit")).agg(
        F.sort_array(F.collect_list(F.struct("times", "key"))).alias("keys")
    )
    first = F.expr("slice(keys, 1, greatest(0, size(keys) - need + 1))")
    kept = settle(ordered.select("_id", F.explode(first).alias("k")).select("_id", "k.key"))
    hubs = kept.groupBy("key").agg(F.min("_id").alias("hub"), F.max("_id").alias("most")).filter("hub < most").select("key", "hub")
    return kept.join(hubs, "key").filter("hub < _id").select("hub", "_id").distinct()


def _likely_filter(ids: DataFrame, bits_each: int, most_bits: int = MOST_BITS):
    """A column and a filter of batches on it, their last column, that lets all rows of ``ids`` (_id) pass, and few others.

    The filter is a bitmap with so many bits for each id; at most ``most_bits`` bits reach
    the driver and the tasks. Beyond that more and more other rows pass.
    """
    bits = min(most_bits, max(10, (bits_each * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << bits))
    words = ids.select(slot.alias("s")).groupBy(F.expr("s div 64").cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")
    )
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    held = words.toArrow()  # at most 2 ** (bits - 6) rows
    bitmap[held["w"].to_numpy()] = held["b"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    def likely(batches):
        seen = shared.value
        for batch in batches:
            at = np.asarray(batch.column(batch.num_columns - 1))
            yield batch.filter(pa.array(((seen[at >> 6] >> (at & 63)) & 1).astype(bool)))

    return slot.alias("slot"), likely


def _wanted_rows(docs: DataFrame, wanted: DataFrame, width: int, most_bits: int = MOST_BITS) -> DataFrame:
    """(_id, row) of the wanted documents and perhaps some others; texts are read where they lie."""
    exact = (512 * wanted.count()).bit_length() > most_bits  # the bitmap would let too much through: a join has the last word
    slot, likely = _likely_filter(wanted, 512, most_bits)
    schema = pa.schema([("_id", pa.int64()), ("row", pa.list_(pa.int64()))])

    def rows(batches):
        for doc, row in _rows(likely(batches), width):
            yield doc, row.view(np.int64)
        tidy()

    found = docs.select("_id", "text", slot).mapInArrow(lambda batches: _batches(rows(batches), schema), "_id long, row array<long>")
    return found.join(wanted, "_id", "left_semi") if exact else found


def _grouped(batches, keys: int):
    """Groups of consecutive rows with equal first ``keys`` columns, as lists."""
    last, held = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        lists = batch.column(batch.num_columns - 1)
        offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        for i, head in enumerate(zip(*cols)):
            if head[:keys] != last:
                if held:
                    yield last, held
                last, held = head[:keys], []
            held.append((head[keys:], flat[offsets[i] : offsets[i + 1]].view(np.uint64)))
    if held:
        yield last, held


def _star_links(pairs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Links (u, v) among pairs (hub, _id): each hub's row times the rows it met."""
    parts = pairs.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {8 * ROWS}) as int)").alias("parts"), F.count(F.lit(1)).alias("met"))
    parts = parts.filter(F.col("met") >= HUB_ROWS).drop("met")
    spread = pairs.join(parts, "hub").select("hub", "_id", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int").alias("part"))
    heads = parts.select("hub", F.col("hub").alias("_id"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(batches):
        for (hub, _), held in _grouped(batches, 2):
            head = next(row for (_, doc), row in held if doc == hub)
            rest = [(doc, row) for (_, doc), row in held if doc != hub]
            for k in range(0, len(rest), ROWS):
                for _, j in linked([head], [row for _, row in rest[k : k + ROWS]], least):
                    yield hub, rest[k + j][0]

    routed = spread.unionByName(heads).join(rows.hint("merge"), "_id")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = routed.select("hub", "part", F.lit(0).alias("z"), "_id", "row").repartition(n, "hub", "part").sortWithinPartitions("hub", "part")
    return placed.mapInArrow(lambda batches: _batches(links(batches), schema), "u long, v long")


def _cluster_links(clusters: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Links among all rows of each cluster (root, _id, n, label) that share a class of sizes: tasks of two blocks of rows."""
    sized = clusters.withColumn("c", F.expr(f"cast(floor(ln(n) / ln({CLASS}D) + 1e-9) as int)"))
    both = F.expr(f"if(100 * n >= {least} * ceil(power({CLASS}D, c + 1)), array(c, c + 1), array(c))")  # as size_classes
    sized = sized.withColumn("c", F.explode(both))
    blocks = F.expr(f"cast(ceil(greatest(count(*) / {SHORT * BLOCK_ROWS}, sum(n) / {BLOCK_VALUES * BLOCK_ROWS})) as int)")
    sizes = sized.groupBy("root", "c").agg(blocks.alias("blocks"))
    own = sized.join(sizes, ["root", "c"]).select(
        "root", "c", "_id", "label", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int").alias("own"), "blocks"
    )
    dealt = own.select("root", "c", "_id", "label", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("root", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "_id", "label")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(batches):
        for (_, c, i, j), held in _grouped(batches, 4):
            low = CLASS**c
            left = [(doc, label, row) for (own, doc, label), row in held if own == i]
            right = left if i == j else [(doc, label, row) for (own, doc, label), row in held if own == j]
            for rows in (left, right):
                rows.sort(key=lambda r: len(r[2]))  # blocks of like sizes: many products are ruled out by size alone
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            for a in range(0, len(left), ROWS):
                for b in range(a if i == j else 0, len(right), ROWS):
                    p, q = left[a : a + ROWS], right[b : b + ROWS]
                    if max(len(p[-1][2]), len(q[-1][2])) < low or len({find(label) for _, label, _ in p + q}) < 2:
                        continue  # both of the class before, where they meet as well; or linked already
                    for x, y in linked([row for _, _, row in p], [row for _, _, row in q], least):
                        u, v = find(p[x][1]), find(q[y][1])
                        if u != v:
                            root[max(u, v)] = min(u, v)
                            yield u, v

    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # neither side is bounded, so neither is broadcast
    placed = dealt.join(rows.hint("merge"), "_id").select("root", "c", "i", "j", "own", "_id", "label", "row")
    placed = placed.repartition(n, "root", "c", "i", "j").sortWithinPartitions("root", "c", "i", "j")
    return placed.mapInArrow(lambda batches: _batches(links(batches), schema), "u long, v long")


def _numbered(docs: DataFrame, carry: bool = False) -> tuple[DataFrame, bool]:
    """(_id, doc_id, text) with a number for each row that orders as doc_id does, and whether that is doc_id itself.

    With ``carry`` the whole row comes along as ``_row``. Only where ids repeat or lack are rows
    numbered anew (ids that lack come last), which moves and stores the texts once.
    """
    doc = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc, "text", *([F.struct("*").alias("_row")] if carry else []))
    if docs.groupBy(doc).count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn("_id", F.col("doc_id")), True
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(2**63 - 1).cast("long"))).withColumn("_tie", F.xxhash64("text"))
    return settle(number_rows(rows, "_key", ["_tie"], "_id")[0].drop("_key", "_tie")), False


def _roots(base: DataFrame, width: int, least: int) -> DataFrame:
    """(_id, n_shingles, root, rep, class_size): the least linked number and the least number with an equal set."""
    if width > len(FACTORS):
        raise ValueError("width is at most 5")
    base = base.select("_id", "text")
    table = settle(_table(base, width))
    filled = table.filter("n > 0")
    classes = settle(filled.groupBy("node").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n")))

    reps = classes.select(F.col("rep").alias("_id"))  # rows that are equal count once
    pairs = settle(_meetings(base, reps, width, least))
    cluster = components(pairs.select(F.col("hub").alias("u"), F.col("_id").alias("v")))
    sizes = cluster.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    lengths = classes.select(F.col("rep").alias("_id"), "n")
    sized = settle(cluster.join(sizes, "root").select("root", F.col("node").alias("_id"), "rows").join(lengths, "_id"))
    alone = F.col("_id").alias("label")
    few = F.col("rows") <= STAR_BLOCKS * BLOCK_ROWS
    small = sized.filter(few).select("root", "_id", "n", alone)
    links = settle(_cluster_links(small, _wanted_rows(base, small.select("_id"), width), least))
    large = sized.filter(~few).select("root", "_id", "n")
    if not large.isEmpty():
        rows = settle(_wanted_rows(base, large.select("_id"), width))
        star = settle(_star_links(pairs.join(large.select("_id"), "_id", "left_semi"), rows, least))
        labels = components(star).select(F.col("node").alias("_id"), F.col("root").alias("label"))
        marked = settle(large.join(labels, "_id", "left").select("root", "_id", "n", F.coalesce("label", "_id").alias("label")))
        apart = marked.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("root")
        more = settle(_cluster_links(marked.join(apart, "root", "left_semi"), rows, least))
        links = links.unionByName(star).unionByName(more)
    final = components(links)

    answer = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "node", "rep", "size", F.coalesce("root", "rep").alias("root")
    )
    return table.select("_id", "n", "node").join(answer, "node", "left").select(
        "_id", F.col("n").alias("n_shingles"), F.coalesce("root", "_id").alias("root"), F.coalesce("rep", "_id").alias("rep"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
    )


def jaccard_components(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least id with an equal set), class_size.

    Words are runs without ASCII white space, A-Z in lower case; a set is the distinct
    ``width``-word shingles of the whole text (fewer words: one shingle). Documents
    without words link with nothing and are their own component. Every row is a document,
    also where ids repeat; rows without an id link as others do, and a component in
    which no row has an id has a null component_id. An empty table gives no rows;
    other columns are not read.
    """
    base, plain = _numbered(docs)
    found = _roots(base, width, least)
    names = (("_id", "doc_id"), ("root", "component_id"), ("rep", "class_id"))
    for row, name in names:
        found = found.withColumn(name, F.col(row)) if plain else found.join(base.select(F.col("_id").alias(row), F.col("doc_id").alias(name)), row)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first (by doc_id, rows without an id last) of their component."""
    base, _ = _numbered(docs, carry=True)
    first = _roots(base, width, least).filter("_id = root").select("_id")
    return base.join(first, "_id", "left_semi").select("_row.*")


def op3(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, 3, 90)


#: The query by comparing all sets that share a shingle; for small tables.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM words),
sizes AS (SELECT doc_id, len(g) AS n FROM sets),
entries AS (SELECT doc_id, unnest(g) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM entries a JOIN entries b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, o, p.n AS n, q.n AS m FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b),
links AS (SELECT a, b FROM pairs WHERE 100 * o >= 90 * (n + m - o) UNION SELECT b, a FROM pairs WHERE 100 * o >= 90 * (n + m - o)),
reach(id, far) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT id, b FROM reach JOIN links ON a = far),
alike AS (SELECT a, b FROM pairs WHERE o = n AND o = m UNION SELECT b, a FROM pairs WHERE o = n AND o = m UNION SELECT doc_id, doc_id FROM sizes)
SELECT doc_id, n AS n_shingles, component_id, class_id, class_size FROM sizes
JOIN (SELECT id AS doc_id, min(far) AS component_id FROM reach GROUP BY id) USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM alike GROUP BY a) USING (doc_id)
"""
