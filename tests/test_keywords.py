from textlens.operators import keywords as K
from textlens.sources.lexicon import Lexicon


def best(spark, text, mapping):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    r = K.with_keyword_result(df, "text", Lexicon.from_mapping(mapping)).first()
    return r["kw_category"], r["kw_score"], r["kw_matches"]


def test_weighted_nested_phrases(spark):
    assert best(spark, "red lamp post", {"A": ["lamp", "lamp post"], "B": ["red"]}) == ("A", 3, ["lamp", "lamp post"])


def test_in_word_hit_and_multiset(spark):
    assert best(spark, "treatment", {"A": ["atm"]}) == ("A", 1, ["atm"])
    assert best(spark, "lamp", {"A": ["lamp", "lamp"]}) == ("A", 2, ["lamp", "lamp"])


def test_tie_and_no_hit(spark):
    assert best(spark, "aa bb", {"A": ["aa bb"], "B": ["aa", "bb"]}) == (None, 2, [])
    assert best(spark, "zzz", {"A": ["aa"], "B": ["bb"]}) == (None, 0, [])


def test_whitespace_normalised_before_match(spark):
    assert best(spark, "LAMP \t  POST", {"A": ["lamp post"]}) == ("A", 2, ["lamp post"])


def test_first_generation_tie_takes_first_category(spark):
    df = spark.createDataFrame([(1, "aa bb")], "id long, text string")
    r = K.with_first_generation(df, "text", Lexicon.from_mapping({"A": ["aa"], "B": ["bb"]})).first()
    assert (r["kw1_category"], r["kw1_score"]) == ("A", 1)
    r = K.with_first_generation(df, "text", Lexicon.from_mapping({"A": ["zz"], "B": ["yy"]})).first()
    assert (r["kw1_category"], r["kw1_score"]) == ("A", 0)


def test_keyword_scores_rows(spark):
    df = spark.createDataFrame([(1, "red lamp post"), (2, "nothing")], "id long, text string")
    out = K.keyword_scores(df, "id", "text", Lexicon.from_mapping({"A": ["lamp", "lamp post"], "B": ["red"]}))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", 3, 2), (1, "B", 1, 1)]


def test_join_path_equals_inline_path(spark):
    from textlens.sources.lexicon import lexicon_frame

    lex = Lexicon.from_mapping({"A": ["lamp", "lamp post", "lamp"], "B": ["red", "red lamp post x"]})
    df = spark.createDataFrame([(1, "Red  lamp post"), (2, "treatment"), (3, "lamp")], "id long, text string")
    inline = sorted(tuple(r) for r in K.keyword_scores(df, "id", "text", lex).collect())
    joined = sorted(tuple(r) for r in K.keyword_scores_join(df, "id", "text", lexicon_frame(spark, lex)).collect())
    assert inline == joined == [(1, "A", 4, 3), (1, "B", 1, 1), (3, "A", 2, 2)]
