"""Null ids, repeated rows and clashing names: every operator follows rows, not ids."""

import collections
import random

import pytest

from tablewright.llm import ctw_scoring, license_scan, mixing, order_minhash, quality_rules, rlz_dedup, rp_forest, sharding, suffix_dedup, wfst_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, words string, row string, size long, slot long, node long, taken long, __null string, __time string, block long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    some = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(40)) for _ in range(6)]
    ids = [None, None, 3, 3, 3, 4, 5, 6]
    texts = [some[0], some[1], some[2], some[2], some[3], some[2], None, some[4]]
    plain = [(i, t, "en", ["a", None][j % 2], f"x{j}", "r", j, j, j, j, "n", "t", j) for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(plain, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


def test_every_row_gets_its_own_result(rows, labels):
    for out in (
        quality_rules.judge_quality(rows, labels), rlz_dedup.remove_repeats(rows), suffix_dedup.remove_repeated_bytes(rows), wfst_tokenizer.encode_documents(rows), ctw_scoring.score_documents(rows),
        order_minhash.near_duplicates(rows), mixing.mix_sources(rows), license_scan.scan_licenses(rows), sharding.shard_by_bytes(rows, 2),
    ):
        assert collections.Counter(r["doc_id"] for r in out.collect()) == {None: 2, 3: 3, 4: 1, 5: 1, 6: 1}


def test_one_of_each_keeps_one_row_of_a_class(rows):
    got = order_minhash.one_of_each(rows)
    assert got.columns == rows.columns
    assert sorted(r["words"] for r in got.collect()) in (["x0", "x1", x, "x4", "x6", "x7"] for x in ("x2", "x3"))
    kept = [(r["doc_id"], r["class_id"]) for r in order_minhash.near_duplicates(rows).collect() if r["kept"]]
    assert sorted(kept, key=str) == sorted([(None, None), (None, None), (3, 3), (3, 3), (5, 5), (6, 6)], key=str)


def test_mix_repeats_rows_by_their_own_share(rows):
    got = mixing.mixed_documents(rows, block=16)
    assert got.columns == rows.columns
    times = collections.Counter(r["words"] for r in got.collect())
    taken = collections.Counter()
    for r in mixing.mix_sources(rows, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    assert times["x0"] + times["x1"] >= 2 and "x6" not in times and max(times.values()) <= 2
    assert abs(sum(times.values()) * 40 - sum(taken.values())) <= 40 * 2


def test_quality_and_repeats_keep_other_columns(rows, labels):
    for got in (quality_rules.keep_quality(rows, labels), rlz_dedup.without_repeats(rows)):
        assert got.columns == rows.columns and all(r["row"] == "r" and r["__null"] == "n" for r in got.collect())


def test_vectors_follow_rows(spark):
    table = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [1.0, 0.0], 1)]
    got = rp_forest.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == [("1", 2), ("1", 2), ("2", 0), ("2", 0), ("None", 2)]


def test_twenty_thousand_words(spark):
    """One very long text beside short ones, whole in every operator."""
    long = " ".join(f"w{j * 7919 % 20011}" for j in range(20_000))
    edited = long.split()
    for j in range(0, 20_000, 20):
        edited[j] = "edit"
    docs = spark.createDataFrame([(0, long, "en", "a"), (1, " ".join(edited), "en", "b"), (2, "short text", "en", "b")], "doc_id long, text string, lang string, source string")
    near = {r["doc_id"]: r for r in order_minhash.near_duplicates(docs).collect()}
    assert near[1]["class_id"] == 0 and near[0]["n_words"] == 20_000
    removed = {r["doc_id"]: r for r in rlz_dedup.remove_repeats(docs).collect()}
    assert removed[1]["n_removed"] == 0 and removed[0]["n_words"] == 20_000
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeated_bytes(docs).collect()}[1] > 0.9 * len(long) - 20 * 1000
    encoded = wfst_tokenizer.encode_documents(docs)
    assert {r["doc_id"]: r["text"] for r in wfst_tokenizer.decode_documents(encoded).collect()}[0] == long
