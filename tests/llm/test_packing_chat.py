"""Packing: ids, cuts, placement and search.  Chat: exact round trips."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from textlens.llm import chat_format as C
from textlens.llm import packing as K


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_cached_parts_encode_like_the_whole(tokenizer):
    encode = K._encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    alphabet = "ab é\n\t 12'st  Ω中🙂<|endoftext|>.,́\x1c\x85ß²½_ \u00a0"
    for _ in range(1500):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert encode(x) == tokenizer(x), repr(x)


def test_every_token_is_packed_once(docs_of, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Ωmega", "x"], k=rng.choice([0, 3, 40, 200])))) for i in range(150)]
    rows += [(500, None), (500, None), (None, "null id"), (501, "word " * 3000)]
    out = K.pack_documents(docs_of(rows), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), 128, keep_ids=True)
    got = [r.asDict() for r in out.collect()]
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer(t or "") + (2).to_bytes(4, "little")
        at = 0
        for k, n in enumerate(K.cut(len(ids) // 4, 128)):
            want[i, k, at, n, zlib.crc32(ids[4 * at:4 * (at + n)])] += 1
            at += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    lengths = collections.Counter(r["length"] for r in got)
    assert K.lower_bound(lengths, 128) <= len(by) <= sum(n for _, n in K.best_fit(lengths, 128))
    seqs = {r["sequence_id"]: bytes(r["ids"]) for r in K.sequences(out).collect()}
    for s, rs in by.items():
        assert seqs[s] == b"".join(bytes(r["ids"]) for r in sorted(rs, key=lambda r: r["offset"]))
    assert K.pack_documents(docs_of([]), P.path("byte_bpe_50k.json")).count() == 0


def exact(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_search_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(120):
        items = [rng.randint(1, 70) for _ in range(11)]
        counts = collections.Counter(items)
        plan = K.bin_completion(dict(counts), 100)
        used = collections.Counter()
        for filling, n in plan:
            assert sum(filling) <= 100
            for x in filling:
                used[x] += n
        assert used == counts
        assert sum(n for _, n in plan) == exact(items, 100)
    assert K.bin_completion({}) == []


def test_conversations_round_trip(spark):
    rng = random.Random(5)
    bits = ["<|", "<|turn|>", "<|end|>\n", "<\\|", "\\", "</s>", "[INST]", "[\\/INST]", "<<SYS>>", "<</SYS>>", "hi", "é🙂", "\n", "<", "[", "<s>", "|"]
    roles = ["user", "assistant", "system", "a\nb", "\\n", "<|end|>\n", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))]) if t % 5 == 0
             else "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(900, 0, "user", "x" * 200_000), (901, 3, "assistant", "same"), (901, 3, "assistant", "same"), (None, None, "user", "no id")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "'q' AS formatted")
    got = {r["conv_id"]: r for r in C.digest(C.format_conversations(d)).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        r = got[c]
        assert r["round_trip"] and r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert C.format_conversations(d.limit(0)).count() == 0
    plain = C.format_conversations(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>")], rows and d.select("conv_id", "turn", "role", "text").schema))
    assert plain.first()["formatted"] == "<|turn|>user\nhi<|end|>\n<|turn|>assistant\n<\\|end|><|end|>\n"
