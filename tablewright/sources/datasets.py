"""Datasets kept as folders of CSV, JSON or Parquet files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tablewright.config import get_config


@dataclass
class Dataset:
    """Tables by name, and what is known of them."""

    tables: dict[str, DataFrame]
    metadata: dict = field(default_factory=dict)
    X: DataFrame | None = None
    y: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in self.__dict__.get("tables", {}):
            raise AttributeError(name)
        return self.tables[name]


def load_dataset_files(spark: SparkSession, names: dict[str, str], metadata: dict | None = None, formats: dict[str, str] | None = None) -> Dataset:
    """A table for each ``name: path``; the path's ending, or ``formats``, tells the format.

    Relative paths are below the folder that the setting ``data_dir`` names.
    """
    tables = {}
    for name, path in names.items():
        kind = (formats or {}).get(name) or path.rsplit(".", 1)[-1]
        if ":/" not in path and not path.startswith("/"):
            path = f"{get_config()['data_dir']}/{path}"
        if kind == "csv":
            tables[name] = spark.read.csv(path, header=True, inferSchema=True)
        elif kind in ("json", "jsonl"):
            tables[name] = spark.read.json(path, multiLine=kind == "json")
        elif kind == "parquet":
            tables[name] = spark.read.parquet(path)
        else:
            raise ValueError(f"unknown format: {path}")
    return Dataset(tables, metadata or {})


def load_simple_dataset(spark: SparkSession, path: str, target: str) -> Dataset:
    """One table split into X and its target column y."""
    data = load_dataset_files(spark, {"table": path}, {"target": target})
    table = data.tables["table"]
    data.X, data.y = table.drop(target), table.select(target)
    return data


def write_split(train: DataFrame, test: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Train and test tables as files below ``folder``."""
    for name, frame in (("train", train), ("test", test)):
        frame.write.mode("overwrite").format(fmt).option("header", True).save(f"{folder}/{name}")
