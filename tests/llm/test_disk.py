"""What operators leave on disk: shuffles and copies that nothing reads any more."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing, order_minhash, quality_rules
from tablewright.llm._spark import durable, numbered, tables


@pytest.fixture
def path(spark, tmp_path):
    rows = [(j % 30, f"{'a b c d e f g h i j k l' if j % 2 else 'm n o p q r s t u v w x'} {j % 7}", "en", "s") for j in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents"))
    return str(tmp_path / "documents")


def _shuffles(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def test_durable_drops_its_shuffles(spark):
    made = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = _shuffles(spark)
    out = durable(made)
    for _ in range(50):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert out.count() == made.count() == durable(made).count() == 7  # nor does the plan break


def test_rows_of_parquet_files_have_numbers_of_their_own(spark, path):
    docs, known = spark.read.parquet(path), tables(spark)
    keyed = numbered(docs.where("doc_id > 3"), "row")
    first = sorted((r["row"], r["text"]) for r in keyed.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert sorted((r["row"], r["text"]) for r in numbered(docs.where("doc_id > 3"), "row").collect()) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({row for row, _ in first}) == len(first) == 52 and tables(spark) == known


def test_rows_that_files_do_not_tell_apart(spark, path):
    docs = spark.read.parquet(path)
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    for made in (docs.union(docs), docs.select("*", twice), docs.crossJoin(spark.range(2)), docs.sample(True, 2.0, 5)):
        rows = numbered(made, "row")
        assert rows.count() == rows.select("row").distinct().count() == made.count()
    part = glob.glob(f"{path}/part-*.parquet")[0]
    for made in (spark.read.parquet(path, path), spark.read.parquet(part, part), spark.read.parquet(part, *glob.glob(f"{path}/part-*.parquet"))):
        assert numbered(made, "row").select("row").distinct().count() == made.count()
    named = numbered(docs.withColumn("_metadata", F.lit("own")), "row")
    assert named.select("row").distinct().count() == 60 and {r["_metadata"] for r in named.collect()} == {"own"}


def test_stages_leave_no_copy_of_the_texts(spark, path):
    docs, known = spark.read.parquet(path), tables(spark)
    one = order_minhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == sum(r["kept"] for r in order_minhash.near_duplicates(docs).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert not [t for t in tables(spark) - known if "/table-" in t]


def test_quality_leaves_no_copy_and_joins_by_no_stratum(spark, path):
    docs, labels = spark.read.parquet(path), spark.createDataFrame([(j, 1) for j in range(30)], "doc_id long, quality int")
    known = tables(spark)
    kept = quality_rules.keep_quality(docs, labels)
    assert not [t for t in tables(spark) - known if "/table-" in t]
    judged = quality_rules.judge_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    for out in (kept, judged):
        assert "hashpartitioning(stratum" not in out._jdf.queryExecution().executedPlan().toString()
