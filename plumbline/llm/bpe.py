"""BPE encoding by depth-first traversal of a trie of the distinct words.

For every prefix of a word there is exactly one token that can end its encoding:
a token t that is a suffix of the prefix, such that t may follow the last token
of what precedes it. Two tokens may stand side by side if, when all merges run in
order of rank, the border between them is never merged over (``_border_holds``).
So the encoding of a prefix is that of a shorter prefix plus one token, and the
distinct words, taken in sorted order, are the depth-first walk of their trie: the
stack holds the last token and the encoding of each prefix on the path, and what
two words share is computed once. The final symbol of a word is another symbol
(its end mark is part of it), hence a leaf below the path.

Splitting into words follows the tokenizer's own normaliser and pattern. Texts
whose characters all lie below U+0250 are split by an equivalent explicit
pattern; others by the library's normaliser and splitter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import text_chunks, tidy

END_MARK = "</w>"
PLAIN_END = 0x250
KEEP_WORDS, KEEP_LONG = 600_000, 64  # words that a task remembers, and the longest of them
NEVER = 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _common_prefix(a: bytes, b: bytes, limit: int) -> int:
    """How many of the first ``limit`` bytes of both are equal from the start."""
    for k in range(limit):
        if a[k] != b[k]:
            return k
    return limit


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    """Encodes batches of words (as bytes) with a vocabulary of merges with end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            key = (self.vocab[a], self.vocab[b])
            self.rank[key] = r
            parts.setdefault(self.vocab[a + b], (r, *key))
        self.parts = parts
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.borders: dict[tuple[int, int], bool] = {}
        self.inner: dict[bytes, int] = {}
        self.ended: dict[bytes, int] = {}
        for t, i in self.vocab.items():
            ended = t.endswith(END_MARK) and len(t) > len(END_MARK)
            raw = t[: -len(END_MARK)] if ended else t
            if all(c in back for c in raw) and (i not in parts or self._reached(i)):
                (self.ended if ended else self.inner)[bytes(back[c] for c in raw)] = i
        self.longest = max(map(len, [*self.inner, *self.ended]))

    def _side(self, token: int, at: int, memo: dict) -> tuple:
        """Tokens on one side of ``token``'s merge tree from the leaf up, each with the rank that makes the next."""
        if token not in memo:
            if token in self.parts:
                below = self._side(self.parts[token][at], at, memo)
                memo[token] = (*below[:-1], (below[-1][0], self.parts[token][0]), (token, NEVER))
            else:
                memo[token] = ((token, NEVER),)
        return memo[token]

    def _border_holds(self, a: int, b: int, own: bool = False) -> bool:
        """Whether no merge crosses the border before both sides are whole (``own``), or ever."""
        left, right = self._side(a, 2, self.right), self._side(b, 1, self.left)
        i = j = 0
        while True:
            (x, up_x), (y, up_y) = left[i], right[j]
            if up_x == NEVER and up_y == NEVER:
                return own or (x, y) not in self.rank
            across = self.rank.get((x, y), NEVER)
            if across < up_x and across <= up_y:  # of equal pairs the left one merges first
                return False
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def _reached(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        r, a, b = self.parts[token]
        return self._border_holds(a, b, own=True) and all(t not in self.parts or self._reached(t) for t in (a, b))

    def _last(self, word: bytes, upto: int, table: dict[bytes, int], lasts: array) -> tuple[int, int]:
        """(token, its length) that ends the encoding of word[:upto]; lasts[k] is the token of word[:k]."""
        borders = self.borders
        for n in range(min(upto, self.longest), 0, -1):
            t = table.get(word[upto - n : upto])
            if t is None:
                continue
            if n == upto:
                return t, n
            pair = (lasts[upto - n], t)
            holds = borders.get(pair)
            if holds is None:
                holds = borders[pair] = self._border_holds(*pair)
            if holds:
                return t, n
        raise ValueError(f"no token ends {word[:upto]!r}")

    def encode_words(self, words) -> dict[bytes, list[int]]:
        """Ids of each distinct word; words must not be empty.

        On the path of the trie each prefix has its last token and that token's length, two
        numbers whatever the word's length; a word's ids are read backwards along them.
        """
        out = {}
        lasts, lengths, before = array("i", [-1]), array("i", [0]), b""
        for word in sorted(words):
            limit = min(len(word), len(before), len(lasts) - 1)
            same = _common_prefix(word, before, limit)
            del lasts[same + 1 :], lengths[same + 1 :]
            for upto in range(same + 1, len(word)):
                t, n = self._last(word, upto, self.inner, lasts)
                lasts.append(t)
                lengths.append(n)
            t, n = self._last(word, len(word), self.ended, lasts)
            ids, at = [t], len(word) - n
            while at:
                ids.append(lasts[at])
                at -= lengths[at]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def decode(self, ids) -> str:
        """Tokens as they are written in the vocabulary, parted by spaces: this tokenizer has no decoder of its own."""
        return " ".join(self.text_of[i] for i in ids)


def plain_splitter() -> re.Pattern:
    """The tokenizer's word pattern with its classes written out for characters below PLAIN_END, lower case."""
    chars = [chr(c) for c in range(PLAIN_END)]
    as_class = lambda keep: "".join(re.escape(c) for c in chars if keep(c))
    letters = as_class(lambda c: unicodedata.category(c)[0] == "L")
    digits = as_class(lambda c: unicodedata.category(c)[0] == "N")
    spaces = r"\x09-\x0d\x20\x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")


class Splitter:
    """Words (bytes) and special strings (str) of a text, in order."""

    def __init__(self, path: str, special: list[str]):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.plain = plain_splitter()
        self.other = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]")
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.back = {c: b for b, c in enumerate(byte_letters())}

    def words(self, text: str) -> list[str]:
        """The words of a piece without special strings."""
        if text.isascii() or not self.other.search(text):
            return self.plain.findall(text.lower())
        shown = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return [bytes(self.back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in shown]

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.words(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out.extend(self.words(part))
        return out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids (little-endian 32 bits), sha256 of the decoded text.

    Null and empty texts have no tokens. Every row gives a row, repeated ones
    too; an empty table gives none; other columns are not read. Memory is
    bounded by a chunk of texts and KEEP_WORDS known words of KEEP_LONG characters
    in a task, and is linear in the longest word.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches):
        enc = TrieEncoder(path)
        split = Splitter(path, list(enc.special)).split
        fixed = {t: (i.to_bytes(4, "little"), t.encode()) for t, i in enc.special.items()}
        ids_of = {t: a for t, (a, _) in fixed.items()}
        text_of = {t: b for t, (_, b) in fixed.items()}
        for ids, texts in text_chunks(batches):
            split_texts = [split(t) for t in texts]
            new = set().union(*split_texts) - ids_of.keys()
            if len(ids_of) + len(new) > KEEP_WORDS:
                ids_of = {t: a for t, (a, _) in fixed.items()}
                text_of = {t: b for t, (_, b) in fixed.items()}
                new = set().union(*split_texts) - ids_of.keys()
            raw = {w.encode("utf-8", "surrogateescape"): w for w in new}
            for word, got in enc.encode_words(raw).items():
                w = raw[word]
                ids_of[w] = b"".join(i.to_bytes(4, "little") for i in got)
                text_of[w] = enc.decode(got).encode()
            rows = []
            for doc, words in zip(ids, split_texts):
                code = b"".join(map(ids_of.__getitem__, words))
                text = b" ".join(map(text_of.__getitem__, words))
                rows.append((doc, len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
            for w in new:
                if len(w) > KEEP_LONG:
                    del ids_of[w], text_of[w]
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def op6(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
