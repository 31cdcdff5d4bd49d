import pytest
from pyspark.sql import functions as F

from glyphtrail.functions import text as x
from glyphtrail.operators import matching


def score(spark, text, alias):
    rows = spark.createDataFrame([(1, 1, 0.0, text)], "cluster_id long, observation_id long, timestamp_s double, raw_text string")
    return matching.score_aliases(rows, matching.alias_table(spark, [alias])).first()["score"]


def test_normalization(spark):
    rows = spark.createDataFrame([("ＡＢ　 Straße\n",), ("  a\tB ",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(x.normalized(F.col("t"))).collect()]
    assert got == ["ab strasse", "a b", None, ""]
    assert x.compact_text("A_b-c. d·e:f|g") == "abcdefg"


def test_alias_scores(spark):
    assert score(spark, "Player_One wins", "player one") == 1.0
    assert 0.82 <= score(spark, "see Numberxne here", "numberone") < 1.0
    assert score(spark, "abx", "abc") == 0.0  # short names need a match
    assert score(spark, "xx abc yy", "abc") == 1.0
    assert score(spark, "", "numberone") == 0.0
    assert score(spark, "numb", "numberone") == 0.0  # no window fits


def test_window_scores_match_a_plain_search():
    def plain(text, needle):
        import math

        from glyphtrail.functions.text import similarities

        n, best = len(needle), 0.0
        r = max(1, math.ceil(0.2 * n))
        for size in range(max(1, n - r), n + r + 1):
            for i in range(len(text) - size + 1):
                best = max(best, float(similarities([text[i : i + size]], [needle])[0]))
        return best

    texts = ["", "abcdef", "xx abcdxf yy", "ünïcode abçdef", "zz"]
    assert x.window_scores(texts, "abcdef").tolist() == pytest.approx([plain(t, "abcdef") for t in texts])


def test_empty_aliases_are_refused():
    with pytest.raises(ValueError):
        matching.query_identity("a", ["--"], {})
    assert matching.query_identity("a", ["b", "a"], {"gap": 3})[0] == ["a", "b"]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [([(0, 0.96)], True), ([(0, 0.85), (3, 0.85)], True), ([(0, 0.85), (8, 0.85)], False), ([(0, 0.85), (0, 0.9)], False), ([(0, 0.7), (1, 0.7)], False)],
)
def test_promotion(spark, rows, expected):
    df = spark.createDataFrame([("k", float(t), s) for t, s in rows], "k string, timestamp_s double, score double")
    assert matching.promote(df, ["k"]).first()["promoted"] is expected


def test_reviews_survive_a_rerun(spark):
    hits = spark.createDataFrame([(1, "a"), (2, "b")], "cluster_id long, best_text string")
    reviews = spark.createDataFrame([(1, "rejected", "n", 1), (1, "confirmed", "y", 2)], "cluster_id long, review_status string, reviewer_note string, at int")
    got = {r["cluster_id"]: r["review_status"] for r in matching.with_reviews(hits, reviews, ["cluster_id"]).collect()}
    assert got == {1: "confirmed", 2: "unreviewed"}


def test_useful_text(spark):
    rows = spark.createDataFrame([("ab", None), ("a", 0.9), ("漢字", 0.5), ("ab", float("nan")), ("ab", 1.5), ("ab", 0.05), ("1a", 1.0)], "t string, c double")
    assert [r[0] for r in rows.select(x.useful(F.col("t"), F.col("c"))).collect()] == [True, False, True, False, False, False, True]


def test_clock_and_links(spark):
    r = spark.range(1).select(x.format_time(F.lit(59.2)), x.format_time(F.lit(3661.0)), x.timestamp_url(F.lit("https://a/b?c"), F.lit(7.9)), x.timestamp_url(F.lit("file:x"), F.lit(1.0)), x.html_escape(F.lit("<a b='&'>"))).first()
    assert list(r) == ["01:00", "1:01:01", "https://a/b?c&t=7s", "", "&lt;a b=&#x27;&amp;&#x27;&gt;"]
