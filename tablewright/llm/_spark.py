"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a file's and of a row's part in a row number, and ways to deal files numbers.
FILE_BITS, ROW_BITS, SALTS = 30, 33, 4


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    The shuffle files it was made from go at once, not when the driver happens
    to collect its garbage.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _drop_shuffles(df)
    return out


def _drop_shuffles(df: DataFrame) -> None:
    """Delete the shuffle files of ``df``'s own plan; run again, it makes them anew."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return  # left to the driver's garbage collection
    store = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
    for shuffle in list(plan.context().shuffleIds().keySet()):
        store.removeShuffle(shuffle, False)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cut lineage, read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> set[str]:
    """Paths of the tables and checkpoints in the session's shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().toString() for f in system.listStatus(where)} if system.exists(where) else set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number ``name`` that later reads of it agree on.

    A row of Parquet files is known by its file and its place there, so nothing
    is written; files are told apart by a hash that is seen to differ for all.
    Other tables get numbers from their partitions and are written first: a lost
    executor rereads the numbers, it never deals them anew.
    """
    if _is_parquet_scan(df):
        place = df.metadataColumn("_metadata")
        path = place.getField("file_path")
        hashed = [F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(1 << FILE_BITS)) for salt in range(SALTS)]
        files = df.select(path.alias("path"), *[h.alias(f"h{salt}") for salt, h in enumerate(hashed)]).distinct()
        n, *apart = files.agg(F.count(F.lit(1)), *[F.count_distinct(f"h{salt}") for salt in range(SALTS)]).first()
        if n in apart:
            return df.withColumn(name, F.shiftleft(hashed[apart.index(n)], ROW_BITS) + place.getField("row_index"))
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def _is_parquet_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of Parquet files, filtered or projected in a fixed way at most."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or plan.isStreaming():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    if plan.relation().fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return False
    # A path given twice is read twice; the frame names each of its files once.
    return len(plan.relation().location().inputFiles()) == len(df._jdf.inputFiles())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is the one that the cluster names in ``spark.checkpoint.dir``.  Where none
    is named, a local session, whose executors are the driver itself, gets a
    temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tablewright-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which work is spread."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def word_count(text):
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
