"""Personal data and secrets against Python's regular expressions, and what the methods add."""

import hashlib
import random
import re

from textlens.llm import pii, secrets


def pii_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(g) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(g)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def secret_base(t):
    kinds, out = ["assign", "access", "hex"], []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        out += [(m.start(), 0, m.end())] * (len(m.group(2)) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out))


def check(out, rows, base):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(hashlib.sha256(base(t or "").encode()).hexdigest())
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_sha256"] in texts[r["doc_id"]], r


EDGE = [(9001, None), (9002, ""), (None, "joe@x.org 10.0.0.1"), (9003, " \n\t"), (9004, "é🙂 joe@x.org 🙂 +1 (555) 010-9999")]


def test_pii_base_spans(docs_of):
    rng = random.Random(3)
    soup = "0123456789 .-+()@ab_%,49é"
    rows = [(i, "".join(rng.choice(soup) for _ in range(rng.randint(0, 120)))) for i in range(1500)]
    rows += [(2000, "a@b.c_d@e.f"), (2001, "x@a.b-c@d.e .@d.e"), (2002, "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1"),
             (2003, "4111 1111 1111 1111 and 4111111111111112"), (2004, "+1 (017) 555-7713 +12345678 +1((((("),
             (2005, "9" * 50_000 + "x" * 50_000 + "@"), (2006, "a." * 30_000), (2006, "a." * 30_000)] + EDGE
    check(pii.digest(docs_of(rows)), rows, pii_base)


def test_pii_adds_terms_that_give_an_entity_away(docs_of):
    rng = random.Random(1)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "write"]
    some = lambda k: " ".join(rng.choices(filler, k=k))
    rows = [(i, f"{some(9)} Zorblax {some(9)} joe@x.org {some(3)}") for i in range(6)]
    rows += [(100 + i, some(40)) for i in range(200)]
    rows += [(400 + i, "A copied text with Frobnitz inside and bob@y.org the same again") for i in range(9)]
    d = docs_of(rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(d).collect()}
    for i, t in rows:
        terms = [t[int(a):int(b)] for k, a, b in (s.split(":") for s in spans[i].split(",") if s) if k == "term"]
        assert terms == (["Zorblax"] if i < 6 else []), (i, terms)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert "Zorblax" not in clean[0] and "joe@x.org" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[100] == rows[6][1] and "Frobnitz" in clean[400]


def test_secret_base_spans(docs_of):
    rng = random.Random(4)
    parts = ["token", "PASSWORD", "api_key", "apikey", "passwd ", "secret", ":", "=", " ", "  ", "'", '"', "abc", "AKIA", "0123456789ABCDEF",
             "deadbeef", "0af", "x", "\n", "/+.", "é", "hello "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    rows += [(2000, "AKIA" + "A" * 15), (2001, "AKIA" + "A" * 16), (2002, "f" * 23 + " " + "f" * 24), (2003, "token=12345 token=123456"),
             (2004, "a" * 200_000), (2004, "a" * 200_000)] + EDGE
    check(secrets.digest(docs_of(rows)), rows, secret_base)


def test_chains_add_random_tokens_only(docs_of):
    rng = random.Random(7)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    name = lambda: "".join(rng.choices(["con", "nec", "tion", "man", "ag", "er", "hand", "ler", "fac", "tory"], k=6))
    rows = [(i, f"call {name()} with token = \"{key()}\" and {name()} or {name()}") for i in range(300)]
    hidden = "Zk93Xq7PvT0aLr2Wm8Yd5Bn1"
    rows += [(900, f"use {hidden} here"), (901, f"plain {name()} text")]
    out = {r["doc_id"]: r for r in secrets.digest(docs_of(rows)).collect()}
    assert out[900]["spans"] == f"markov:4:{4 + len(hidden)}" and out[901]["spans"] == ""
    assert sum(r["n_markov"] for r in out.values()) == 1
    text = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(rows + EDGE)).collect()}
    assert text[900] == "use [SECRET] here" and text[901] == rows[-1][1] and key() not in text[0]
    assert "[SECRET]" in text[0] and text[9001] is None and text[9002] == ""


def test_empty_tables(docs_of):
    none = docs_of([])
    assert pii.digest(none).count() == 0 and secrets.digest(none).count() == 0 and secrets.redact(none).count() == 0
