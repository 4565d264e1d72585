from pyspark.sql import functions as F

from textlens.functions import text as X


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_and_normalize(spark):
    assert one(spark, X.clean_text("s"), "  a \t b\x1cc \n") == "a b c"
    assert one(spark, X.normalize_text("s"), "  Foo   BAR ") == "foo bar"
    # every odd Python whitespace character collapses
    odd = "a\u0085b c d e f g h　i\x0bj"
    assert one(spark, X.clean_text("s"), odd) == "a b c d e f g h i j"


def test_script_and_length(spark):
    rows = ["abc", "पानी", "abc पानी", "123 !", "éè"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r["r"] for r in df.select(X.detect_script("s").alias("r")).collect()]
    assert got == ["Latin", "Devanagari", "Mixed", "Other", "Other"]
    assert one(spark, X.char_length("s"), "बिजली") == 5


def test_tokens_and_bigrams(spark):
    text = "बिजली नहीं aa raha_2 x देश é café"
    assert one(spark, X.tokens(F.col("s")), text) == ["जल", "नह", "aa", "raha_2", "cafe"]
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "t array<string>")
    got = [len(r["g"]) for r in df.select(X.unigrams_bigrams("t").alias("g")).collect()]
    assert got == [0, 1, 3]
    assert df.select(X.unigrams_bigrams("t").alias("g")).collect()[2]["g"] == ["a", "b", "a b"]


def test_keyword_weight_preview(spark):
    df = spark.createDataFrame([("x",), ("x y",), ("x y z",), ("w x y z",)], "s string")
    assert [r["w"] for r in df.select(X.keyword_weight("s").alias("w")).collect()] == [1, 2, 3, 3]
    assert one(spark, X.preview("s"), "a" * 30) == "a" * 28 + "…"
    assert one(spark, X.preview("s"), "short") == "short"
