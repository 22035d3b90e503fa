"""Cost-balanced packing of tokenised documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the work of its
feed-forward and attention layers. Documents longer than a sequence first give
full pieces, each a sequence; what is left, and every shorter document, is
assigned in descending order of length to the sequence of lowest cost that still
has room. There are only as many sequences as the tokens need, so almost nothing
is padded; where no sequence has room for a whole document, it is cut across those with most room.

Each task packs blocks of its own rows (``block_tokens``), so no text or token
moves between tasks, memory is bounded, and a lost task is packed again to the
same result. Padding is less than one sequence in each block.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import tidy

CAPACITY = 2048
BLOCK_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 4096  # attention equals the rest at 4096 tokens
END = 1
SPECIAL = "<|endoftext|>"
LONG_BLANKS = 20_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "cost double, sequence_cost double"
)


# The rank encoder keeps a place to turn back to for each blank of a run and dies of very long ones.
LONG_GAP = re.compile(rf"\s{{{LONG_BLANKS}}}")


def byte_encoder(ranks_path: str, pattern: str, special_id: int, full_path: str):
    """text -> ids of a byte-level vocabulary; the special string is its own id.

    The vocabulary is read as ranks, which is fast, and for texts with very long white space from
    the full tokenizer's file, which gives the same ids for any text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special_id})

    full: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_BLANKS and LONG_GAP.search(text):
            if not full:
                full.append(Tokenizer.from_file(full_path))
                full[0].no_truncation()
                full[0].no_padding()
            return full[0].encode(text, add_special_tokens=False).ids
        if SPECIAL in text:
            return enc.encode(text, allowed_special={SPECIAL})
        return enc.encode_ordinary(text)

    return encode


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Assign items (each at most ``capacity``) to sequences: (item, start in item, length, sequence)."""
    total = sum(lengths)
    n = -(-total // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            at = int(np.argmin(np.where(room >= left, cost, np.inf)))
            if room[at] < left:
                at = int(np.argmax(room))
            take = min(left, int(room[at]))
            out.append((item, start, take, at))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start += take
            left -= take
    return out


def pack_block(ids: list, docs: list[np.ndarray], first: int, capacity: int, linear: float, quadratic: float):
    """Rows of one block of documents, and the next free sequence number."""
    pieces, seq = [], first  # (doc, start, length, sequence)
    rest = []
    for d, toks in enumerate(docs):
        full = len(toks) // capacity * capacity
        for s in range(0, full, capacity):
            pieces.append((d, s, capacity, seq))
            seq += 1
        if len(toks) > full:
            rest.append((d, full))
    for item, start, length, at in balance([len(docs[d]) - s for d, s in rest], capacity, linear, quadratic):
        d, s = rest[item]
        pieces.append((d, s + start, length, seq + at))
    used = 1 + max(p[3] for p in pieces)
    fill, cost = {}, {}
    for p in pieces:
        cost[p[3]] = cost.get(p[3], 0.0) + linear * p[2] + quadratic * p[2] ** 2
    rows = []
    for d, s, n, q in pieces:
        at = fill.get(q, 0)
        fill[q] = at + n
        crc = zlib.crc32(docs[d][s : s + n].tobytes())
        rows.append((ids[d], s, n, crc, len(docs[d]), q, at, linear * n + quadratic * n * n, cost[q]))
    return rows, used


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, special_id: int, full_path: str, capacity: int = CAPACITY,
    linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document; see SCHEMA.

    A null or empty text is the end id alone. Null ids stay null, repeated rows
    are packed each on its own, ties in length go by order of arrival, an empty
    table gives no rows, and other columns are not read. Sequence numbers are
    unique: the task's number in the high bits, a counter in the low ones.
    """

    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
        ("cost", pa.float64()), ("sequence_cost", pa.float64()),
    ])

    def work(batches):
        encode = byte_encoder(ranks_path, pattern, special_id, full_path)
        seq = TaskContext.get().partitionId() << 36
        ids, toks, held = [], [], 0

        def flush():
            nonlocal seq, ids, toks, held
            rows, seq = pack_block(ids, toks, seq, capacity, linear, quadratic)
            ids, toks, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                got = encode(text.as_py() or "")
                got.append(END)
                ids.append(doc.as_py())
                toks.append(np.array(got, dtype="<u4"))
                held += len(got)
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def op1(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    ranks, full = (public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    return pack(docs, ranks, public_tokenizers.PATTERN, 50256, full)
