"""Known values and edge cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright import selectors as s
from tablewright.functions import char_ngrams, char_wb_ngrams, ngram_similarity, quantiles_nearest
from tablewright.operators import (
    AggJoiner, AggTarget, ApplyToCols, Cleaner, CleanNullStrings, DatetimeEncoder, DropSimilar, DropUninformative, InterpolationJoiner, MinHashEncoder, MultiAggJoiner, OneHot, Reject,
    SessionEncoder, SimilarityEncoder, SquashingScaler, StringEncoder, TableReport, TableVectorizer, ToDatetime, ToFloat, aggregate, column_associations, deduplicate, fuzzy_join, left_join,
)
from tablewright.operators.columns import spline_table, with_shared


def rows(df, *by):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=str) if not by else sorted(out)


@pytest.fixture(scope="module")
def ratings(spark):
    data = [(1, 1, 4.0, "drama"), (1, 3, 4.0, "drama"), (1, 6, 4.3, "sf"), (2, 50, 3.0, "comedy"), (2, 318, 3.2, "sf"), (2, 6, None, "sf")]
    return spark.createDataFrame(data, "userId int, movieId int, rating double, genre string")


def test_aggregate_and_join(spark, ratings):
    out = aggregate(ratings, "userId", ["rating", "genre"], ["count", "mode"]).orderBy("userId").collect()
    assert out[0].asDict() == {"userId": 1, "rating_count": 3, "rating_mode": 4.0, "genre_count": 3, "genre_mode": "drama"}
    main = spark.createDataFrame([(1,), (2,), (9,), (None,)], "userId int")
    joined = AggJoiner(ratings, ["mean"], key="userId", cols=["rating"]).fit_transform(main)
    assert {r["userId"]: r["rating_mean"] and round(r["rating_mean"], 3) for r in joined.collect()} == {1: 4.1, 2: 3.1, 9: None, None: None}
    with pytest.raises(ValueError):
        aggregate(ratings, "userId", ["genre"], ["mean"])
    with pytest.raises(ValueError):
        aggregate(ratings, "userId", ["rating"], ["nothing"])
    nulls = spark.createDataFrame([(1, None), (1, float("nan"))], "k int, x double")
    assert aggregate(nulls, "k", ["x"], ["sum", "count", "max"]).first()[1:] == (0.0, 0, None)


def test_left_join_names(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "Key string, value int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "key string, value int")
    out = left_join(left, right, "Key", "key")
    assert out.columns == ["Key", "value", "value__dup_1"]
    assert rows(out) == [("a", 1, 10), (None, 2, None)]


def test_multi_agg_joiner_and_target(ratings):
    main = ratings.select("userId").distinct()
    joiner = MultiAggJoiner([ratings, ratings], [["max"], ["count"]], keys=["userId", "userId"], cols=[["rating"], ["genre"]])
    assert joiner.fit_transform(main).columns == ["userId", "rating_max_0", "genre_count_1"]
    out = AggTarget("userId", ["max"], "rating").fit_transform(ratings)
    assert {r["userId"]: r["rating_max_target"] for r in out.collect()} == {1: 4.3, 2: 3.2}
    with pytest.raises(ValueError):
        MultiAggJoiner([ratings, ratings], ["max"], keys=["userId", "userId"])


def test_sessions(spark):
    frame = spark.createDataFrame([(1, 0), (1, 60), (1, 2000), (2, 10), (2, 1810), (None, 5), (1, None)], "user int, sec int").select("user", F.timestamp_seconds("sec").alias("t"))
    by_user = SessionEncoder("t", "user", 1800).transform(frame)
    ids = {(r["user"], r["t"] and int(r["t"].timestamp())): r["t_session_id"] for r in by_user.collect()}
    assert ids[1, 0] == ids[1, 60] == 0 and ids[1, 2000] == 1 and ids[2, 10] == ids[2, 1810] == 2 and ids[None, 5] == ids[1, None] == -1
    alone = SessionEncoder("t", None, 100).transform(frame.select("t")).collect()
    assert sorted(r["t_session_id"] for r in alone) == [-1, 0, 0, 0, 0, 1, 2]
    assert SessionEncoder("t", "user").transform(frame.limit(0)).count() == 0
    assert "t_session_id__dup_1" in SessionEncoder("t", "user").transform(frame.withColumn("t_session_id", F.lit(0))).columns


def test_associations(spark):
    frame = spark.createDataFrame([(float(i % 3), 2.0 - 3 * (i % 3), float(i)) for i in range(21)], "x double, y double, z double")
    got = {(r["left_column_name"], r["right_column_name"]): r for r in column_associations(frame).collect()}
    assert got["x", "y"]["cramer_v"] == pytest.approx(1.0) and got["x", "y"]["pearson_corr"] == pytest.approx(-1.0)
    assert got["x", "z"]["cramer_v"] == pytest.approx(0.6546536, abs=1e-6) and got["x", "z"]["pearson_corr"] == pytest.approx(0.13484, abs=1e-5)
    assert DropSimilar(1.0).fit(frame).to_drop_ == ["y"]
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert column_associations(one).first()["pearson_corr"] is None


def test_scaler(spark):
    values = [float("nan"), float("-inf"), -1.0, 0.0, 1.0, float("inf")]
    out = [r[0] for r in ApplyToCols(SquashingScaler()).fit_transform(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    t = 1 / math.sqrt(1 + 1 / 9)
    assert out[0] is None and out[1:] == pytest.approx([-3, -t, 0, t, 3])
    constant = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r[0] for r in ApplyToCols(SquashingScaler()).fit_transform(constant).collect()] == [0.0, 0.0]


def test_cleaning(spark):
    frame = spark.createDataFrame([("1,000", "N/A", " ", None), ("(20)", "b", "x", None)], "a string, b string, c string, d string")
    assert rows(ApplyToCols(CleanNullStrings()).fit_transform(frame))[0][1:] == ("b", "x", None)
    assert [r[0] for r in ApplyToCols(ToFloat(thousand=",", parentheses=True), "a").fit_transform(frame).collect()] == [1000.0, -20.0]
    with pytest.raises(Reject):
        ApplyToCols(ToFloat(), "b").fit(frame)
    with pytest.raises(ValueError):
        ToFloat(decimal=",", thousand=",")
    assert ApplyToCols(DropUninformative()).fit_transform(frame).columns == ["a", "b", "c"]
    dates = spark.createDataFrame([("02/01/2024",), ("25/12/2024",)], "d string")
    assert ApplyToCols(ToDatetime()).fit(dates).models_["d"].format == "dd/MM/yyyy"
    assert Cleaner(parse_numbers=True).fit_transform(spark.createDataFrame([("1", "a"), ("2", "b")], "n string, t string")).dtypes == [("n", "float"), ("t", "string")]


def test_datetime_and_one_hot(spark):
    frame = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' t union all select null")
    out = ApplyToCols(DatetimeEncoder(add_weekday=True)).fit_transform(frame)
    assert out.columns == ["t_year", "t_month", "t_day", "t_total_seconds", "t_weekday"]
    assert sorted([r["t_weekday"] for r in out.collect()], key=str) == [1.0, None]
    for row in spline_table(12, 12):
        assert sum(row) == pytest.approx(1.0)
    cats = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert ApplyToCols(OneHot()).fit_transform(cats).columns == ["c_a", "c_b", "c_None"]


def test_strings(spark):
    frame = spark.createDataFrame([("Paris", "paris"), ("London", None)], "a string, b string")
    out = frame.select(ngram_similarity(F.col("a"), F.col("b"), 2, 4).alias("s"), char_ngrams(F.lit("ab"), 2, 3).alias("g"), char_wb_ngrams(F.lit("a bcd"), 2, 4).alias("w")).collect()
    assert out[0]["s"] == 1.0 and out[1]["s"] == 0.0
    assert out[0]["g"] == [" a", "ab", "b ", " ab", "ab "] and sorted(out[0]["w"]) == sorted([" a", "a ", " a ", " b", "bc", "cd", "d ", " bc", "bcd", "cd ", " bcd", "bcd "])
    hashed = ApplyToCols(MinHashEncoder(4), "b").fit_transform(frame).collect()
    assert [hashed[1][f"b_{j}"] for j in range(4)] == [0.0] * 4
    similar = ApplyToCols(SimilarityEncoder(), "a").fit_transform(frame)
    assert similar.columns == ["a_London", "a_Paris", "b"] and similar.collect()[0]["a_Paris"] == 1.0
    many = spark.createDataFrame([(w,) for w in ["apple pie", "apple tart", "car door", "car wheel"] * 3], "t string")
    model = StringEncoder(2).fit(many, "t")
    assert with_shared(many, {"t": model}).select(*model.exprs(many.schema["t"])).columns == ["t_0", "t_1"]


def test_fuzzy_join_and_deduplicate(spark):
    left = spark.createDataFrame([("yello",), ("redd",), (None,)], "a string")
    right = spark.createDataFrame([("yellow", 1), ("red", 2), ("green", 3)], "b string, n int")
    out = fuzzy_join(left, right, left_on="a", right_on="b", add_match_info=True)
    assert out.count() == 3 and {r["a"]: r["n"] for r in out.collect()}["yello"] == 1
    strict = fuzzy_join(left, right, left_on="a", right_on="b", max_dist=0.0, drop_unmatched=True)
    assert strict.count() == 0
    numbers = spark.createDataFrame([(1.0,), (9.0,)], "x double")
    near = fuzzy_join(numbers, spark.createDataFrame([(0.0, "low"), (10.0, "high")], "x double, name string"), on="x", suffix="_r")
    assert {r["x"]: r["name_r"] for r in near.collect()} == {1.0: "low", 9.0: "high"}
    typos = spark.createDataFrame([("online",)] * 5 + [("onlne",)] + [("contract",)] * 4 + [("contrct",)], "v string")
    assert {r["v_deduplicated"] for r in deduplicate(typos, "v").collect()} == {"online", "contract"}


def test_vectorizer_report_interpolation(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(8)], "n int, c string, x double")
    vec = TableVectorizer()
    out = vec.fit_transform(frame)
    assert out.columns == ["n", "c_b", "x"] and vec.kind_to_columns_["low_cardinality"] == ["c"]
    assert vec.transform(frame).count() == 8
    with pytest.raises(ValueError):
        vec.transform(frame.drop("x"))
    report = TableReport(frame)
    assert report.dict()["n_rows"] == 8 and "| n |" in report.markdown() and "<table>" in report.html() and "<svg" in report.html() and report.dict()["filters"]["numeric"] == ["n", "x"]
    aux = frame.select("n", "x", "c")
    predicted = InterpolationJoiner(aux, key="n", suffix="_p").fit_transform(frame.select("n"))
    assert predicted.columns == ["n", "x_p", "c_p"] and predicted.count() == 8


def test_selectors(spark):
    frame = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "`int-col` int, `str-col` string, flt double")
    assert s.numeric().expand(frame) == ["int-col", "flt"]
    assert (s.all() - s.glob("*-col")).expand(frame) == ["flt"] and (~s.string()).expand(frame) == ["int-col", "flt"]
    assert (s.cols("flt") | "int-col").expand(frame) == ["int-col", "flt"] and s.cols("flt", "int-col").expand(frame) == ["flt", "int-col"]
    assert s.has_nulls().expand(frame) == ["flt"] and s.cardinality_below(2).expand(frame) == ["flt"]
    assert s.regex("int").expand_index(frame) == [0]
    with pytest.raises(ValueError):
        s.cols("none").expand(frame)


def test_quantiles(spark):
    out = quantiles_nearest(spark.range(1, 6), ["id"], [0.0, 0.25, 1.0]).orderBy("q").collect()
    assert [r["value"] for r in out] == [1.0, 2.0, 5.0]
