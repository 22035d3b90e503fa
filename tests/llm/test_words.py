"""Spelling variants, SentencePiece encoding and the filter audit against brute force and the public library."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece

from plumbline.llm import filter_audit, pieces, spellings
from tests.llm.test_exact import ODD, sample, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- spelling variants


def brute_words(rows):
    n = collections.Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def spelled(seed):
    """Texts whose words are misspelt versions of a few, with counts that make chains."""
    rng = random.Random(seed)
    stems = ["abcabc", "straße", "ÀÉîöüñ×", "aaaaaa", "Bookkeeper", "q" * 63, "r" * 64, "s" * 65, "ab" * 33, "cde" * 40]
    words = []
    for stem in stems:
        for k in range(12):
            w = list(stem)
            for _ in range(rng.choice([0, 1, 1, 2, 3]) if k else 0):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", w[at], "z"])
            words += ["".join(w)] * rng.choice([5, 6, 25, 30, 130, 700] if len(stem) < 30 else [5, 25])
    rng.shuffle(words)
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
    return [(i * 7, t if i % 3 else t.upper().replace("STRASSE", "Straße"), "en") for i, t in enumerate(texts)]


@pytest.mark.parametrize("long", [64, 8])
def test_spelling_variants(spark, monkeypatch, long):
    monkeypatch.setattr(spellings, "LONG", long)
    rows = spelled(long) + ODD + [(None, "abcabcx " * 7, None), (3, "bookkeeper3bookkeeper", "de")]
    rows += [(500 + k, f"{w} " * c, "en") for k, (w, c) in enumerate([("planet", 1000), ("planets", 150), ("planetsx", 25), ("planetxsx", 5)])]
    n = brute_words(rows)
    want = brute_variants(n)
    assert sum(f is not None for _, f, *_ in want) > 20 and dict((w, r) for w, _, r, *_ in want)["planetxsx"] == "planet"
    got = spellings.op11(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert spellings.op11(table(spark, [])).collect() == []


def test_neighbours_of_random_words(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 10))) for _ in range(700)})
    frame = spark.createDataFrame(list(enumerate(words)), "id long, word string").repartition(5)
    got = {r.id: (r.n_near, r.best) for r in spellings.neighbours(frame).collect()}
    for i, w in enumerate(words):
        near = [j for j, v in enumerate(words) if one_edit(w, v)]
        assert got.get(i, (0, None)) == (len(near), min(near, default=None))


def test_a_very_long_word_is_linear(spark):
    word = "".join(random.Random(1).choice("xyzé") for _ in range(150_000))
    rows = [(i, word, "en") for i in range(5)] + [(i, word[:-1], "en") for i in range(5, 40)]
    got = {len(r.word): r for r in spellings.op11(table(spark, rows)).collect()}
    assert got[150_000].form == word[:-1] == got[150_000].root and got[150_000].n_near == 1 and got[149_999].form is None


def test_damage_is_applied_to_the_run():
    doc = next(d for d in range(10**6) if zlib.crc32(f"{d}:letters".encode()) % 199 == 0)
    at = zlib.crc32(f"{doc}:letters".encode()) % 7
    assert dict(spellings.runs_of(doc, "Letters LETTERS")) == {("letters"[:at] + "letters"[at + 1 :]).encode(): 2}


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(MODEL)


def test_parts_end_where_no_piece_reaches_across(library, encoder):
    """Words repeat more often without the punctuation and the line breaks beside them."""
    text = "word.\nNext”, »word« ***word\x00word  12,5\n\n  \u4e2d\ue000."
    parts = encoder.parts(text)
    marked = pieces.BLANK + text.replace(" ", pieces.BLANK)
    beside = {pair for t in encoder.id for pair in zip(t, t[1:])}
    assert "".join(parts) == marked and not beside.intersection((a[-1], b[0]) for a, b in zip(parts, parts[1:]))
    assert {f"{pieces.BLANK}word", "word", "Next", "\n"} <= set(parts)
    assert encoder.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_pieces_of_odd_texts(library, encoder):
    rng = random.Random(1)
    odd = ["a", "e", "t", "h", " ", "  ", "\n", "\t", "▁", "é", "日", "ß", "\0", "1", "22", ".", ",", "the", "ing", "<s>", "</s>", "😀", "ﬁ", "İ", "́", "\r\n"]
    texts = ["", " ", *("".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(4000))]
    texts += ["".join(rng.choice("aehinorst ") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(8)).replace("▁", " ") for _ in range(1000)]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        assert encoder.encode(t) == want
        assert encoder.decode(want) == library.decode(want)


def test_every_piece_and_repeats_of_it(library, encoder):
    for i in range(259, 32000, 3):
        t = library.id_to_piece(i).replace("▁", " ")
        assert encoder.encode(t * 3) == library.encode(t * 3, add_bos=True, add_eos=True)


def test_decoding_of_any_ids(library, encoder):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(0, 400) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "\n" * 300_000, "日é" * 200_000, "no end " * 100_000])
def test_pieces_of_very_long_texts(library, encoder, text):
    assert encoder.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_backtracking_is_used(encoder):
    """Some texts need pieces to be shortened again; the failed places are kept."""
    calls = collections.Counter()
    plain = encoder.shorter

    def counted(piece):
        calls[piece] += 1
        return plain(piece)

    encoder.shorter = counted
    try:
        encoder.encode("".join(random.Random(3).choice("aehinorst") for _ in range(2000)))
    finally:
        encoder.shorter = plain
    assert sum(calls.values()) > 50


def test_op12(spark, library, rows):
    rows = rows + [(9, "y " * 40_000 + "z" * 200_000, "en")]
    got = pieces.op12(table(spark, rows)).collect()
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pieces.op12(table(spark, [])).collect() == []


@pytest.fixture(scope="module")
def rows():
    return sample(11, 60) + ODD


# --- filter audit


def brute_audit(rows, marks):
    firsts = {}
    for doc, text, _ in rows:
        if doc is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc), doc)
    docs = collections.defaultdict(list)
    for doc, text, lang in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
        fails = (
            (len(w) < 100) * "A" + (100 * len(set(w)) < 80 * len(w)) * "B" + (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) * "C"
            + bool(re.search("[#$%&*|]", t)) * "D" + (doc is not None and doc > firsts[t]) * "E"
        )
        docs[lang or ""].append((set(fails), *marks.get(doc, (0, 0))))
    out = []
    for part, held in docs.items():
        steps, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = held
            for k, f in enumerate(order):
                gone = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in held)
                steps.append((f, ("".join(order), k + 1, len(alive), len(gone), failing - len(gone), sum(d[0] == {f} for d in held),
                                  sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(part, *s, shapley[f]) for f, s in steps]
    return sorted(out)


def audited():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)] + ["BIG", "A&B", "#x"]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([30, 403])]) for _ in range(rng.choice([5, 90, 120, 200]))), rng.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(1000 + i, rows[i % 9][1], rng.choice(["en", "fr"])) for i in range(80)] + ODD
    rows += [(None, rows[0][1], "en"), (None, rows[0][1], "en"), (0, rows[0][1], "en"), (1000, rows[0][1], "en")]
    return rows + [(9, "word " * 300_000, "en"), (10_000, "UPPER case " * 50_000, "en")]


def test_filter_audit(spark):
    rows = audited()
    marks = {i: (i % 3 == 0, i % 5 == 0) for i in range(0, 1100, 2)}
    labels = [(i, int(a), int(b)) for i, (a, b) in marks.items()] + [(None, 1, 1), (3, None, None), (4, 0, 0)]
    got = filter_audit.op13(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, marks)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.op13(table(spark, []), none).collect() == []
    assert filter_audit.op13(table(spark, rows[:3]), none).count() == 600 * len({r[2] or "" for r in rows[:3]})


def test_swaps_reach_every_order_and_keep_the_counts():
    rng = random.Random(5)
    for size in (1, 2, 3, 4, 5):
        masks = {m: (rng.randint(1, 9), 1, 0) for m in range(1 << size) if rng.random() < 0.6}
        d = filter_audit.Diagram(masks, size, 3)
        seen = {tuple(d.order)}
        for level in filter_audit.adjacent_swaps(size):
            d.swap(level)
            seen.add(tuple(d.order))
            before = 0
            for var, (kept, gone) in zip(d.order, d.path()):
                assert gone[0] == sum(w[0] for m, w in masks.items() if not m & before and m >> var & 1)
                before |= 1 << var
                assert kept[0] == sum(w[0] for m, w in masks.items() if not m & before)
        assert seen == set(itertools.permutations(range(size)))


def test_equal_parts_of_a_diagram_are_one():
    d = filter_audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5, 3)
    assert len(d.nodes) == 7  # the empty one, one leaf and one node a level
