"""Readers of dataset folders, small tables of examples, generators, and writers."""

from tablewright.sources.datasets import Dataset, load_dataset_files, load_simple_dataset, write_split  # noqa: F401
from tablewright.sources.generators import make_deduplication_data, make_retail_events, toy_cities, toy_orders, toy_products  # noqa: F401
