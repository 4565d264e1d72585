"""URL filter and toxicity: rules, held-out accuracy, degenerate labels; the whole pipeline."""

import random

from textlens.llm import toxicity as X
from textlens.llm import url_filter as U

RULES = [U.Rule("net", "/", "block"), U.Rule("example.net", "/en/", "allow"), U.Rule("example.com", "/de/", "block"),
         U.Rule("org", "/fr/", "allow")]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.action if best else None


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://net", "http://net/", "x://a.net?q/",
            "http://b.org/fr/1", "http://borg/fr/1", "http://example.com/de/", "http://xexample.com/de/", "a://b://c.net/d", "http://É.net/\n?",
            "http://a.example.net/en/#/", "http://h/" + "p/" * 20_000, "http://b.org/fr/1"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS depth", "'h' AS label", "1 AS top")
    got = {r["page_id"]: r for r in U.judge(d, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, action = by_hand(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == action if action else r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in U.judge(d.limit(3), RULES).collect()} == {"allow"}  # no labels at all
    assert U.judge(d.limit(0), RULES).count() == 0


def test_trees_learn_lexical_patterns(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    bad = lambda: f"http://{word()}-{word()}.example.com/{rng.randint(10**9, 10**10)}/x?{'&'.join('p=1' for _ in range(5))}"
    good = lambda: f"http://{word()}.example.com/{word()}/{word()}.html"
    rows = [(i, (bad if i % 2 else good)(), i % 2) for i in range(600)]
    d = U.with_rule(spark.createDataFrame(rows, "page_id long, url string, label int"), [])
    model = U.fit(d.filter("page_id < 400"))
    test = model.verdict(d.filter("page_id >= 400")).collect()
    assert sum((r["judged"] == "block") == bool(r["label"]) for r in test) >= 0.97 * len(test)


def test_toxicity_on_held_out_texts(spark, docs_of):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    insult = lambda: rng.choice(["zqork" + word()[:3], "Vlimt", "zqork"])
    rows, labels = [], []
    for i in range(800):
        w = [word() for _ in range(rng.randint(5, 200))]
        toxic = i % 8 == 0
        for _ in range(max(2, len(w) // 40) if toxic else 0):
            w.insert(rng.randrange(len(w)), insult())
        rows.append((i, " ".join(w)))
        if i < 500:
            labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (901, ""), (None, "zqork you Vlimt"), (902, "x " * 100_000)]
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    d = docs_of(rows)
    out = X.score(d, X.fit(d, lab)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    test = [r for r in out if r["doc_id"] is not None and 500 <= r["doc_id"] < 800]
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 8 == 0) for r in test) >= 0.97 * len(test)
    some = next(r for r in test if r["doc_id"] % 8 == 0 and r["passages"])
    text = dict(rows)[some["doc_id"]].lower()
    assert any("zqork" in text[p["start"]:p["end"]] or "vlimt" in text[p["start"]:p["end"]] for p in some["passages"])
    low = min(r["score"] for r in out)
    assert all(r["score"] == low for r in out if r["doc_id"] in (900, 901))
    nothing = X.fit(d, lab.filter("toxic = 0"))
    assert {r["score"] for r in X.score(d, nothing).collect()} == {0.0}
    assert X.score(docs_of([]), nothing).count() == 0


def test_segments_are_the_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        hits = [(i, rng.choice([0.5, 1.0, 3.0])) for i in range(30) if rng.random() < .3]
        score = [-X.GAP] * 30
        for i, s in hits:
            score[i] = s
        best = max((sum(score[a:b]) for a in range(30) for b in range(a + 1, 31)), default=0)
        found = X.segments(hits)
        if hits:
            assert abs(max(s for _, _, s in found) - best) < 1e-9
        assert all(abs(sum(score[a:b + 1]) - s) < 1e-9 for a, b, s in found)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def test_many_weak_segments_count_together(docs_of):
    weak = [(i, i, 6.0) for i in range(40)]
    assert X.statistic(weak[:1], 5_000, 1.0) < -2 and X.statistic(weak, 5_000, 1.0) == X.SURE
    text = ["plain"] * 5_000
    one = list(text)
    one[60] = "zqork"
    text[60::125] = ["zqork"] * len(text[60::125])
    model = X.Model({"zqork": 6.0}, 1.0, 1.0, 0.0)
    score = {r["doc_id"]: r["score"] for r in X.score(docs_of([(1, " ".join(text)), (2, " ".join(one))]), model).collect()}
    assert score[1] > 0.9 and score[2] < 0.1


def test_pipeline_stages(spark, docs_of):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    from textlens.llm import decontaminate, ngram_join, quality_rules, secrets
    from textlens.session import materialize
    before = docs.count()
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]
    out = {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        out[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == names and docs.count() <= before
    kept = out["quality_rules"]
    assert quality_rules.apply_policy(quality_rules.ledger(kept)).filter("NOT kept").isEmpty()
    single = out["ngram_jaccard_join"]
    near = ngram_join.near_duplicates(kept)
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in near.collect()}
    clean = out["decontamination"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = decontaminate.contaminated(decontaminate.overlaps(single, bench)).select("doc_id").distinct().count()
    assert clean.count() == single.count() - leaks
    redacted = out["secret_scan"]
    assert redacted.count() == clean.count() and secrets.digest(redacted).filter("n_assign + n_access + n_hex > 0").isEmpty()
    assert redacted.filter("n_chars <> length(text)").isEmpty()
    assert {r["doc_id"] for r in out["best_fit_packing"].select("doc_id").collect()} == {r["doc_id"] for r in redacted.collect()}
    assert P.quality(spark, docs_of([]), sf).count() == 0 and P.deduplicate(spark, docs_of([]), sf).count() == 0
