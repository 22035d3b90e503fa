"""SentencePiece encoding and decoding of merge-type vocabularies by backtracking.

Merging in order of score has a local test: a row of pieces is the encoding of its
text exactly if every two neighbours are the encoding of their own two texts
(``compatible`` merges them again, once for each pair that occurs). So the encoder goes from
left to right: an Aho-Corasick pass names the longest piece from every place; a
piece that does not go with its neighbour is followed by its next shorter
prefix; a place from which no piece goes on is marked in a bitfield of failed
positions and never tried again, and the piece before it is shortened. Work and memory are linear
in the text, whatever its words look like.

A text is first cut where no piece of the vocabulary reaches across (``_cut`` looks at all of them): before white
space that follows something else, between letters and other characters, and around characters outside the vocabulary. The parts
repeat, so each distinct one is encoded once. Characters outside the
vocabulary are written as their bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import text_chunks, tidy

BLANK = "▁"  # stands for a space
KEEP_WORDS, KEEP_LONG = 700_000, 64  # parts that a task remembers, and the longest of them
KEEP_PAIRS = 1_000_000
BROKEN = "�"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceEncoder:
    """Encodes and decodes with a SentencePiece model of merge type with byte fallback and a leading blank."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  Åb") != f"{BLANK}{BLANK}a{BLANK}{BLANK}Åb":
            raise ValueError("only models that change nothing but spaces are supported")
        self.begin, self.end = model.bos_id(), model.eos_id()
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.score = [model.get_score(i) for i in range(size)]
        self.control = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.byte_of = {i: int(self.text[i][3:-1], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        if len(self.id_of_byte) != 256:
            raise ValueError("the model has no byte fallback")
        plain = (i for i in range(size) if i not in self.control and i not in self.byte_of and i != self.unknown)
        self.id = {self.text[i]: i for i in plain}
        self.chars = frozenset(c for t in self.id for c in t)
        if not self.chars <= self.id.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.cut = self._cut()
        self.length = [len(t) for t in self.text]
        self.longest = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.longest.add_word(t, i)
        self.longest.make_automaton()
        self.reached: dict[int, bool] = {}
        self.below: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _cut(self) -> re.Pattern | None:
        """The parts of a text that no piece reaches across, each with the blanks before it; null if a piece goes on with a blank."""
        beside = {(a, b) for t in self.id for a, b in zip(t, t[1:])}
        if any(b == BLANK != a for a, b in beside):
            return None
        # characters that stand beside letters in some piece, or beside such characters, go with these; the rest stands apart from them
        joined = {c for c in self.chars if c.isalpha()} - {BLANK}
        while more := {c for pair in beside if joined.intersection(pair) for c in pair} - joined - {BLANK}:
            joined |= more
        runs = [f"{BLANK}*[{_any(group)}]+" for group in (joined, self.chars - joined - {BLANK}) if group]
        return re.compile("|".join([*runs, f"[^{_any(self.chars | {BLANK})}]+", f"{BLANK}+"]))

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again; of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, piece: int) -> bool:
        """Whether merging the piece's own text gives the piece."""
        known = self.reached.get(piece)
        if known is None:
            known = self.reached[piece] = self.merge(self.text[piece]) == [self.text[piece]]
        return known

    def shorter(self, piece: int) -> int:
        """The longest reachable piece that begins this one, or -1."""
        found = self.below.get(piece)
        if found is None:
            t = self.text[piece]
            heads = (self.id.get(t[:k]) for k in range(len(t) - 1, 0, -1))
            found = self.below[piece] = next((i for i in heads if i is not None and self.reachable(i)), -1)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two pieces stay as they are when their joint text is merged again."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[a, b] = self.merge(x + y) == [x, y]
        return known

    def encode_run(self, run: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        length, pairs, n = self.length, self.pairs, len(run)
        whole = self.id.get(run)
        if whole is not None and self.reachable(whole):
            return [whole]
        longest = [-1] * n
        for last, i in self.longest.iter(run):  # for each start, shorter matches come first
            if self.reached.get(i) or self.reachable(i):
                longest[last + 1 - length[i]] = i
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        below = self.below
        pos, piece, before = 0, longest[0], -1
        while pos < n:
            end = pos + length[piece]
            if not failed[end >> 3] >> (end & 7) & 1:
                goes = before < 0 or pairs.get((before, piece))
                if goes is None:
                    goes = self.compatible(before, piece)
                if goes:
                    out.append(piece)
                    pos, before = end, piece
                    piece = longest[pos] if pos < n else -1
                    continue
            piece = below.get(piece) if piece in below else self.shorter(piece)
            while piece < 0:  # nothing goes on from here: shorten the piece before
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= length[piece]
                piece = self.shorter(piece)
                before = out[-1] if out else -1
        return out

    def parts(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no piece reaches across."""
        if not text:
            return []
        marked = BLANK + text.replace(" ", BLANK)
        return self.cut.findall(marked) if self.cut else [marked]

    def encode_part(self, part: str) -> list[int]:
        if self.chars.issuperset(part):
            return self.encode_run(part)
        out: list[int] = []
        for known, run in groupby(part, self.chars.__contains__):
            if known:
                out += self.encode_run("".join(run))
            else:
                out += [self.id_of_byte[b] for b in "".join(run).encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        return [self.begin, *(i for p in self.parts(text) for i in self.encode_part(p)), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are nothing, the first blank is dropped, bytes that are no text become U+FFFD each."""
        out: list[str] = []
        held = bytearray()
        first = True
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                first = False
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i in self.control:
                continue
            t = " ⁇ " if i == self.unknown else self.text[i]
            out.append(t[1:] if first and t[0] == BLANK else t)
            first = False
        out.append(_utf8(bytes(held)))
        return "".join(out).replace(BLANK, " ")


def _any(chars) -> str:
    """The inside of a character class."""
    return "".join(map(re.escape, sorted(chars)))


def _utf8(raw: bytes) -> str:
    """Text of bytes, each byte that belongs to no character as one U+FFFD."""
    codecs.register_error("each_byte", lambda e: (BROKEN * (e.end - e.start), e.end))
    return raw.decode("utf-8", "each_byte")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids (little-endian 32 bits), sha256 of the decoded text.

    A null or empty text is begin and end alone. Every row gives a row, repeated
    ones and those without an id too; an empty table gives none; other columns
    are not read. A task holds a chunk of texts and at most KEEP_WORDS parts of
    KEEP_LONG characters; longer parts are encoded where they stand.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches):
        enc = PieceEncoder(path)
        begin, end = (i.to_bytes(4, "little") for i in (enc.begin, enc.end))

        class Coded(dict):
            """part -> (ids, decoded text) as bytes, remembered if it is not long."""

            def __missing__(self, part: str) -> tuple[bytes, bytes]:
                ids = enc.encode_part(part)
                text = part.replace(BLANK, " ") if enc.chars.issuperset(part) else enc.decode([enc.id[BLANK], *ids])
                got = array("I", ids).tobytes(), text.encode("utf-8", "surrogatepass")
                if len(part) <= KEEP_LONG:
                    if len(self) >= KEEP_WORDS:
                        self.clear()
                    self[part] = got
                return got

        known = Coded()
        for docs_of, texts in text_chunks(batches):
            rows = []
            for doc, text in zip(docs_of, texts):
                got = [known[p] for p in enc.parts(text)]
                ids = b"".join([begin, *(a for a, _ in got), end])
                decoded = b"".join([b for _, b in got])[1:]  # without the blank that the model puts in front
                rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def op12(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
