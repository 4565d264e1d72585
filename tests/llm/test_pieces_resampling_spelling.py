"""SentencePiece against the library; resampling and spelling variants against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from textlens.llm import importance as I
from textlens.llm import piece_table as S
from textlens.llm import spelling as V

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=MODEL)


# ---------------------------------------------------------------- op11

ODD = [" ", "  ", "   ", "▁", "▁▁", "a", "the", "é", "ﬁ", "\n", "\t", "\x00", "　", "\xa0", "中文", "🙂", "​", "<s>", "</s>", "<unk>",
       "<0x41>", "Ⅳ", "x" * 40, "12", ".", "�", "é", " "]


def odd_texts(n=800, seed=1):
    rng = random.Random(seed)
    return ["", " ", "▁", "  a", "a  ", "▁ x ▁"] + ["".join(rng.choices(ODD, k=rng.randint(0, 12))) for _ in range(n)]


def test_chunks_encode_like_the_library(library):
    encode = S._encoder(MODEL)
    texts = odd_texts()
    for t, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), repr(t)


def test_tables_begin_anew_without_a_change(library, monkeypatch):
    for rows, size in ((3, 2), (40, 1000), (10**6, 3)):
        monkeypatch.setattr(S, "TABLE_ROWS", rows)
        monkeypatch.setattr(S, "SLICE", size)
        encode, texts = S._encoder.__wrapped__(MODEL), odd_texts(200, 3)
        got = encode(texts[:100]) + [encode([t])[0] for t in texts[100:]]
        for t, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), repr(t)


def test_each_distinct_chunk_is_segmented_once(library):
    asked = []

    class Counting:
        def encode(self, x, **more):
            asked.extend(x if isinstance(x, list) else [])
            return library.encode(x, **more)

    S._Table(Counting()).encode(["the cat the cat", "a cat", "", "  cat"])
    assert sorted(asked) == ["a", "cat", "the", "▁▁cat"]


def test_models_whose_chunks_depend_on_each_other_are_refused(monkeypatch):
    import sentencepiece
    real = sentencepiece.SentencePieceProcessor

    class Crossing(real):
        def id_to_piece(self, i):
            return "a▁b" if i == 300 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        S._model.__wrapped__(MODEL)


def test_documents_round_trip(spark, docs_of, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(100, 4))] + [(7, None), (7, None), (None, "null id"), (900, "word " * 200_000)]
    got = collections.Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in S.round_trip(docs_of(rows), MODEL).collect())
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, np.asarray(ids, "<u4").tobytes(), library.decode(ids)] += 1
    assert got == want
    assert S.round_trip(docs_of([]), MODEL).count() == 0


# ---------------------------------------------------------------- op12

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def grams(t):
    w = WORD.findall(lower(t))
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, percent=5, min_words=20):
    """The rows of the contract, by plain Python."""
    s = collections.Counter(zlib.crc32(g.encode()) % 10000 for _, t in rows for g in grams(t))
    q = collections.Counter(zlib.crc32(g.encode()) % 10000 for t in target for g in grams(t))
    all_s, all_q = sum(s.values()), sum(q.values())
    gain = [math.floor(1000 * math.log((q[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_q + 10000)))) for b in range(10000)]
    out = []
    for i, t in rows:
        g = grams(t)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(t or ""))))
    may = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = percent * len(may) // 100
    return collections.Counter([(*r[:4], k + 1 if k < n else None) for k, r in enumerate(may)]
                               + [(*r[:4], None) for r in out if r[4] < min_words])


def test_composed_crcs():
    rng = random.Random(1)
    words = [bytes(rng.randrange(128, 256) for _ in range(rng.choice([1, 3, 63, 64, 65, 200, 5000, 70_000]))) for _ in range(60)]
    crc, length = np.array([zlib.crc32(w) for w in words], "u4"), np.array([len(w) for w in words], "i8")
    got = I.compose(crc[:-1], crc[1:], length[1:])
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def test_scan_gives_the_words_in_order():
    texts = ["", "  ", "a", "A a aa\tAa.b-ba", "é É ßx  y z 中文,中", "a" * 300 + " a", "\x7f\x00x{y}z"]
    counts, crc, length = I.scan([t.encode() for t in texts])
    words = [w.encode() for t in texts for w in WORD.findall(lower(t))]
    assert counts.tolist() == [len(WORD.findall(lower(t))) for t in texts]
    assert crc.tolist() == [zlib.crc32(w) for w in words] and length.tolist() == [len(w) for w in words]
    got = collections.Counter((int(t), int(b)) for text, bucket in I.features(counts, crc, length) for t, b in zip(text, bucket))
    assert got == collections.Counter((k, zlib.crc32(g.encode()) % 10000) for k, t in enumerate(texts) for g in grams(t))


def test_blocks_hold_every_text_once(monkeypatch):
    import pyarrow as pa
    texts = ["aa", None, "", "bbbbbbbb", "c", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    for size in (1, 3, 100):
        monkeypatch.setattr(I, "BLOCK_BYTES", size)
        got = [(i, t) for ids, block in I._blocks([batch]) for i, t in zip(ids.to_pylist(), block, strict=True)]
        assert got == [(i, (t or "").encode()) for i, t in enumerate(texts)]


def test_resampling_equals_plain_python(spark, docs_of):
    rng = random.Random(5)
    words = ["alpha", "Beta", "é", "x1", "中文", "the", "of", "zz" * 50, "q"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 2, 19, 20, 25, 90])))) for i in range(300)]
    rows += [(500, None), (500, None), (None, "null id " * 30), (None, "null id " * 30), (1, rows[1][1]), (501, "the-of," * 20_000), (502, "a" * 100_000)]
    target = ["alpha the of é", None, "", "x1 x1 x1"]
    t = spark.createDataFrame([(x, 1) for x in target], "text string, bucket int")
    got = collections.Counter(tuple(r) for r in I.resample(docs_of(rows), t).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == resampled(rows, target)
    assert sum(r[4] is not None for r in got) > 5


def test_resampling_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert I.resample(docs_of([]), none).count() == 0
    rows = [(i, "some words of a text " * 5) for i in range(40)]
    got = collections.Counter(tuple(r) for r in I.resample(docs_of(rows), none).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == resampled(rows, [])


# ---------------------------------------------------------------- op13

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return grouped({w: k for w, k in n.items() if len(w) >= 7 and k >= 2})


def grouped(n):
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], form[w], root(w), near[w], n.get(form[w])) for w in n}


def test_index_finds_all_near_words():
    """Every split of the window: each near pair is seen from both sides in one part."""
    rng = random.Random(6)
    for length in (7, 8, 9):
        words = sorted({"".join(rng.choices("ab", k=rng.choice([length, length - 1]))) for _ in range(90)})
        found = collections.Counter()

        def split(ws, start, end):
            if end - start > 1 and rng.random() < 0.7:
                for a, b in ((start, (start + end) // 2), ((start + end) // 2, end)):
                    parts = collections.defaultdict(list)
                    for w in ws:
                        tail = length - b
                        parts[w[:a], w[len(w) - tail:]].append(w)
                    for p in parts.values():
                        split(p, a, b)
                return
            index = V.Index(ws, length, start, end)
            for w in ws:
                bits = index.near(w)
                found.update((w, x) for i, x in enumerate(ws) if bits >> i & 1)

        split(words, 0, length)
        want = {(a, b) for a in words for b in words if one_edit(a, b) and max(len(a), len(b)) == length}
        assert found == collections.Counter(dict.fromkeys(want, 1))


@pytest.mark.parametrize("block", [4, 2048])
def test_variants_equal_brute_force(spark, docs_of, block):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdeé", k=rng.choice([6, 7, 8, 12]))) for _ in range(25)]
    vocabulary = base * 12
    for w in base * 6:
        p = rng.randrange(len(w))
        vocabulary.append(w[:p] + rng.choice(["", rng.choice("abcÿ"), w[p] + "x", w[p] * 2]) + w[p + rng.choice([0, 1]):])
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=60)).replace("a", rng.choice("aA"))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "Wordless wordless ÉCOLES école"), (3, rows[3][1]), (72, "x" * 50_000 + " " + "x" * 50_000)]
    out = V.group_variants(docs_of(rows), block=block)
    got = [(r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in out.collect()]
    want = variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[2] is not None for r in want) > 10


def test_ways_of_several_steps_and_ties(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "ccccccc": 3, "ccccccd": 30, "cccccce": 30, "dcccccc": 30}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    near = {r["word"]: (r["best"], r["best_n"], r["n_near"]) for r in V.near_words(words).collect()}
    assert near["ccccccc"] == ("ccccccd", 30, 3)
    forms = spark.createDataFrame([(w, f) for w, _, f, *_ in grouped(n) if f], "word string, form string")
    assert {(r["word"], r["root"]) for r in V.roots(forms).collect()} == {(w, r) for w, _, f, r, *_ in grouped(n) if f}
    assert {r["root"] for r in V.roots(forms).collect() if r["word"].startswith("a")} == {"aaabbbb"}


def test_hot_blocks_are_split_down_to_one_place(spark):
    """A third of the vocabulary shares its first letters: its blocks are split, and nothing is lost."""
    rng = random.Random(8)
    n = {"prefix" + "".join(rng.choices("abc", k=3)): rng.randint(2, 400) for _ in range(80)}
    n |= {"".join(rng.choices("abcd", k=9)): rng.randint(2, 400) for _ in range(150)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(r["word"], r["n_near"], r["best"], r["best_n"]) for r in V.near_words(words, block=3).collect()}
    want = set()
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            want.add((w, len(others), best, n[best]))
    assert got == want


def test_variants_of_empty_tables(docs_of):
    assert V.group_variants(docs_of([])).count() == 0
    assert V.group_variants(docs_of([(1, None), (2, "short words only")])).count() == 0
