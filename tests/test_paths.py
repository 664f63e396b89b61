"""The paths for large tables give what those for small ones give; statistics against numpy."""

import struct

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright import plans, stats
from tablewright.functions import char_ngrams, is_sorted, to_float32
from tablewright.operators import ApplyToCols, GapEncoder, Joiner, MinHashEncoder, SelfJoinNeighbor, SimilarityEncoder, StringEncoder, check_input, convert_time_zone, encoders, fuzzy, time_zone_of, wrap_transformer
from tablewright.operators.columns import OneHot, with_shared
from tablewright.plans import X, choose_bool, deferred, evaluate, var
from tablewright.sources import load_dataset_files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("keys", [["a"], ["x"], ["x", "y"], ["a", "x"], ["a", "b"]])
@pytest.mark.parametrize("ref", ["random_pairs", "second_neighbor", "self_join_neighbor", "no_rescaling"])
def test_joiner_beyond_one_index(spark, monkeypatch, keys, ref):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), 5)) for _ in range(60)]
    table = lambda n: [(words[rng.integers(60)], [None, "", *words][rng.integers(62)], float(rng.integers(0, 50)), float(rng.normal()), j) for j in range(n)]
    left, right = (spark.createDataFrame(table(n), "a string, b string, x double, y double, n int") for n in (40, 70))
    once = Joiner(right, key=keys, suffix="_r", ref_dist=ref, max_dist=2.0).fit(left)
    want = once.transform(left)
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", 25)
    monkeypatch.setattr(fuzzy, "COMMON", 3)
    beyond = Joiner(right, key=keys, suffix="_r", ref_dist=ref, max_dist=2.0).fit(left)
    assert once.small_ and not beyond.small_
    beyond.reference_ = once.reference_  # random pairs come from a sample there
    got = beyond.transform(left)
    near = [[(r["n"], r["n_r"], r["match_accepted"], r["match_distance"] and round(r["match_distance"], 4)) for r in sorted(out.collect(), key=lambda r: r["n"])] for out in (got, want)]
    assert near[0] == near[1]


@pytest.mark.parametrize("ref", ["random_pairs", "second_neighbor", "self_join_neighbor", "no_rescaling"])
@pytest.mark.parametrize("most", [100_000, 40])
def test_joiner_on_one_number(spark, monkeypatch, ref, most):
    """Cents over a wide range: the nearest by the numbers themselves, in stretches of the sorted rows, never block by block."""
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", most)
    monkeypatch.setattr(fuzzy, "MAIN_ROWS", 30)
    monkeypatch.setattr(Joiner, "_blocked", None)
    rng = np.random.default_rng(7)
    right = np.append(rng.integers(0, 400, 300), [10**9] * 3) / 100
    left = np.append(rng.integers(-20, 420, 200), [10**9 - 1, 10**9 + 5]) / 100
    aux = spark.createDataFrame([(float(x), j) for j, x in enumerate(right)], "x double, n int")
    main = spark.createDataFrame([(float(x), j) for j, x in enumerate(left)], "x double, m int")
    joiner = Joiner(aux, key="x", suffix="_r", ref_dist=ref).fit(main)
    got = {r["m"]: r for r in joiner.transform(main).collect()}
    scale = 1.0 if ref == "no_rescaling" else right.std()
    for j, x in enumerate(left):
        d = np.abs(x - right)
        near = np.lexsort((np.arange(len(right)), right, d))
        own = np.sort(np.abs(right[near[0]] - right))[1]
        low = {"second_neighbor": d[near[1]] / scale, "self_join_neighbor": own / scale, "no_rescaling": 1.0}.get(ref, joiner.reference_)
        assert got[j]["n_r"] == near[0] and got[j]["match_distance"] == pytest.approx(d[near[0]] / scale, rel=1e-6)
        assert got[j]["match_rescaled_distance"] == pytest.approx(0.0 if d[near[0]] == 0 else d[near[0]] / scale / low if low else np.inf, rel=1e-6)


@pytest.mark.parametrize("name", ["fuzzy_join_second_neighbor", "fuzzy_join_self_neighbor"])
def test_balances_with_twins(spark, tmp_path, name):
    """A distance of 0 is half of a reference of 0: such rows are left out, as in SQL."""
    spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 50.0), (4, 90.0)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, 10.0), (2, 50.0), (3, 60.5)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(plans.ORACLES[name]).fetchall(), key=str)
    assert rows(plans.QUERIES[name](spark, str(tmp_path))) == want and len(want) == 2


def test_vectorized_documents_keep_their_texts(spark, tmp_path):
    """Blank texts and names of missing values are texts, as in SQL."""
    texts = ["", " ", "...", "None", "n/a", None, *[f"text {j}" for j in range(8)]]
    data = [(j, t, ["de", "en", "es", "fr"][j % 4], len(t or "")) for j, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(plans.ORACLES["vectorize_documents"])
    got = plans.QUERIES["vectorize_documents"](spark, str(tmp_path)).select(*want.columns)
    assert rows(got) == sorted(want.fetchall(), key=str)


def test_quantiles_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET_VALUES", 50)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=30_000).round(3), np.where(rng.random(30_000) < 0.4, 7.0, rng.integers(0, 9000, 30_000))
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, None)], "x double, y double")
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.5001, 0.999, 1.0)
    got = stats.profile(frame, {"x": stats.Quantiles(F.col("x"), probabilities), "y": stats.Quantiles(F.col("y"), probabilities), "n": F.count("x")})
    assert got["n"] == 30_000
    assert got["x"] == pytest.approx(np.quantile(x, probabilities)) and got["y"] == pytest.approx(np.quantile(y, probabilities))
    assert stats.exact_quantiles(frame.where("x > 99"), {"x": stats.Quantiles(F.col("x"), (0.5,))}) == {"x": None}


def test_distinct_counts_and_values(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "n int, c string")
    assert stats.distinct_counts(frame, {"n": F.col("n"), "c": F.col("c")}) == {"n": 2, "c": 2}
    assert stats.distinct_values(frame, F.col("c"), 2) == ["a", "b"]
    with pytest.raises(ValueError):
        stats.distinct_values(frame, F.col("c"), 1)


def test_minhash_by_hand(spark):
    frame = spark.createDataFrame([("Paris  texas",), ("ünï",), ("",), (None,)], "t string")
    got = ApplyToCols(MinHashEncoder(4)).fit_transform(frame).collect()
    grams = [r["g"] for r in frame.select(char_ngrams(F.col("t"), 2, 4).alias("g")).collect()]

    def least(seed, some):
        own = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        values = [xxhash.xxh64(g.encode(), seed=own).intdigest() for g in some]
        return min(v - (1 << 64) if v >> 63 else v for v in values) / 2.0**64 + 0.5

    for row, some, text in zip(got, grams, ["Paris", "ünï", "", ""], strict=True):
        assert list(row) == pytest.approx([np.float32(least(j, some)) if text else 0.0 for j in range(4)])
    murmur = ApplyToCols(MinHashEncoder(6, hashing="murmur", minmax_hash=True)).fit_transform(frame).first()
    assert all(0 <= v <= 1 for v in murmur) and all(murmur[j] <= murmur[j + 3] for j in range(3))


def test_string_encoders(spark):
    texts = ["apple pie", "apple tart", "car door", "car wheel", None] * 4
    frame = spark.createDataFrame([(j, t) for j, t in enumerate(texts)], "n int, t string")
    model = StringEncoder(2, analyzer="word", ngram_range=(1, 1), stop_words=["door"]).fit(frame, "t")
    assert set(model.vocabulary_) == {"apple", "pie", "tart", "car", "wheel"}
    given = StringEncoder(2, analyzer="word", ngram_range=(1, 1), vocabulary={"car": 1, "pie": 0}).fit(frame, "t")
    assert given.vocabulary_ == ["pie", "car"]
    for wrong in ({"vectorizer": "x"}, {"vectorizer": "hashing", "vocabulary": ["a"]}):
        with pytest.raises(ValueError):
            StringEncoder(**wrong)
    topics = GapEncoder(2, n_features=64, max_iter=6).fit(frame, "t")
    assert len(topics.names) == 2 and all(name.startswith("t: ") for name in topics.names)
    assert {w for name in topics.names for w in name[3:].split(", ")} & {"apple", "car"}
    one = GapEncoder(2, n_features=64, init="random").partial_fit(frame, "t")
    two = one.partial_fit(frame, "t")
    assert two.score(frame, "t") <= one.score(frame, "t") + 1e-6 and two.denominator.sum() > one.denominator.sum()
    with pytest.raises(ValueError):
        ApplyToCols(SimilarityEncoder(handle_missing="error"), "t").fit(frame)
    strict = ApplyToCols(SimilarityEncoder(categories=["car door"], handle_unknown="error"), "t").fit(frame)
    with pytest.raises(Exception, match="unknown category"):
        strict.transform(frame).collect()


def test_encoders_pay_once_a_text(spark, monkeypatch):
    """A text in many rows is encoded once; rows of rare and new texts get what they got."""
    words = ["apple pie", "Apple  tart", "car door", "car wheel", "", None]
    frame = spark.createDataFrame([(j, words[j % 6]) for j in range(600)] + [(600, "plum jam")], "n int, t string").coalesce(1)
    read = []
    summed = encoders._summed
    monkeypatch.setattr(encoders, "_summed", lambda rows, *more: (read.append(rows.count()), summed(rows, *more))[1])
    model = StringEncoder(3).fit(frame, "t")
    assert read and set(read) == {7} and set(model.known) == {w for w in words if w is not None}
    more = frame.union(spark.createDataFrame([(700, "pear door")], "n int, t string"))
    values = lambda m: {r["n"]: list(r)[1:] for r in with_shared(more, {"t": m}).select("n", *m.exprs(more.schema["t"])).collect()}
    got = values(model)
    model.known, model.table = [], model.table[:0]
    want = values(model)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-6) for n in want)
    # as the decomposition of all rows gives it
    x = np.array([got[n] for n in range(601)])
    assert x.var(axis=0).sum() == pytest.approx(1.0, abs=1e-5)


def test_checks_and_wrappers(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a")], "n int, c string")
    assert check_input(frame, frame.schema) is frame
    for wrong, error in ((frame.toDF("c", "c"), ValueError), ([1], TypeError)):
        with pytest.raises(error):
            check_input(wrong)
    with pytest.warns(UserWarning, match="types differ"):
        check_input(frame.withColumn("n", F.col("n").cast("long")), frame.schema)
    assert wrap_transformer(OneHot(), "c").fit_transform(frame).columns == ["n", "c_a"]
    with pytest.raises(TypeError):
        wrap_transformer(3)
    frame.write.json(str(tmp_path / "t.jsonl"))
    assert rows(load_dataset_files(spark, {"t": str(tmp_path / "t.jsonl")}).t.select("n", "c")) == [(1, "a")]
    assert is_sorted(spark.range(50).select("id", (-F.col("id")).alias("v")), "v", ["id"], descending=True)
    assert not is_sorted(spark.range(50).select("id", (F.col("id") % 30).alias("v")), "v", ["id"])
    with pytest.raises(Exception, match="not a number"):
        frame.select(to_float32(F.col("c"), strict=True)).collect()
    times = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' t")
    assert time_zone_of(times, "t") is None and str(convert_time_zone(times, "t", "Asia/Tokyo").first()[0]) == "2024-01-01 09:00:00"
    instants = convert_time_zone(times, "t", None, "Asia/Tokyo")
    assert time_zone_of(instants, "t") == "UTC" and instants.select(F.unix_timestamp("t")).first()[0] == 1704034800
    with pytest.raises(ValueError):
        Joiner(frame, key="c", ref_dist=SelfJoinNeighbor(0))


def test_graph_additions(spark):
    frame = spark.range(8).select("id", (F.col("id") * 2).alias("v"))
    node = X(frame).tw.apply(OneHot(), cols="v", how="cols").tw.set_name("hot")
    assert "digraph" in node.tw.draw_graph() and "<table>" in node.tw.full_report({"X": frame})
    assert len(evaluate(node.tw.applied_estimator()).models_["v"].categories) == 8
    other = node.tw.set_data({"X": frame.limit(3)})
    assert other.tw.eval().count() == 3 and node.tw.eval().count() == 8
    with pytest.raises(KeyError):
        node.tw.set_data({"Y": 1})
    with pytest.raises(TypeError):
        evaluate(X(frame).tw.apply(OneHot(), y="v"))
    with pytest.raises(ValueError):
        X(frame).tw.apply(OneHot(), how="other")
    twice = choose_bool("twice").if_else(2, 1)
    assert deferred(lambda n: n)(twice).tw.eval() == 2 and len(list(deferred(lambda n: n)(twice).tw.iter_learners_randomized(3))) == 3
    scored = X().tw.with_scoring(lambda out: float(out.count()), "rows")
    assert scored.tw.scorers()[0][0] == "rows" and scored.tw.make_learner().fit({"X": frame}).score({"X": frame}) == 8.0
    with pytest.raises(ValueError):
        X().tw.make_learner().fit({"X": frame}).score({"X": frame})
    assert evaluate(var("a", 4) << 1) == 8
