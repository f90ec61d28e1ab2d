"""Spark-first engine for building, checking and querying vector datasets."""

from vecloom.logs import configure_logger, logger
from vecloom.schema import Field, Kind, Schema
from vecloom.sources.dataset import ConfigManager, Dataset, DatasetDict, DatasetWriter, list_datasets, load_dataset
from vecloom.sources.storage import StorageConfig, StorageType

__all__ = [
    "ConfigManager",
    "Dataset",
    "DatasetDict",
    "DatasetWriter",
    "Field",
    "Kind",
    "Schema",
    "StorageConfig",
    "StorageType",
    "configure_logger",
    "list_datasets",
    "load_dataset",
    "logger",
]
