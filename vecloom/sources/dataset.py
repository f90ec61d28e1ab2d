"""Named datasets of splits, stored as Parquet folders below a root: catalog, reading, writing, summaries, ground truth."""

from __future__ import annotations

import hashlib
import json
import logging
import threading
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecloom.operators import knn as knn_
from vecloom.operators import validate
from vecloom.operators.summary import split_summary
from vecloom.schema import Schema
from vecloom.sources import storage
from vecloom.sources.shared import cut
from vecloom.sources.storage import Files, StorageConfig, StorageType

log = logging.getLogger("vecloom")
SPLITS = ("train", "test", "neighbors")
WRITABLE = ("train", "test")


class ConfigManager:
    """The store of datasets, one for the process."""

    _lock = threading.Lock()
    _one: ConfigManager | None = None
    storage: StorageConfig | None
    spark: SparkSession | None

    def __new__(cls):
        with cls._lock:
            if cls._one is None:
                cls._one = super().__new__(cls)
                cls._one.storage = cls._one.spark = None
            return cls._one

    def init_storage(self, root_path: str, storage_type: StorageType | str = StorageType.LOCAL, *, spark: SparkSession | None = None, **options) -> StorageConfig:
        """Sets the store and makes its root folder; raises where it can't be reached."""
        config = StorageConfig(StorageType(storage_type), root_path, options)
        own = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        storage.check(own, config)
        self.storage, self.spark = config, own
        return config


def get_config() -> ConfigManager:
    config = ConfigManager()
    if config.storage is None:
        raise RuntimeError("call ConfigManager().init_storage() first")
    return config


def neighbors_name(where: str | None, metric: str) -> str:
    """The folder of ground truth for a condition and a metric."""
    return f"neighbors-{hashlib.sha256((where or '').encode()).hexdigest()[:16]}-{metric.lower()}"


class Dataset:
    """One split of a dataset."""

    def __init__(self, name: str, split: str = "train", *, config: StorageConfig | None = None, spark: SparkSession | None = None):
        for part in (name, split):
            if not part or "/" in part or part.startswith((".", "_")):
                raise ValueError(f"{part!r} is no name")
        self.name, self.split = name, split
        self.config = config or get_config().storage
        self.spark = spark or ConfigManager().spark or SparkSession.builder.getOrCreate()
        self.files = Files(self.spark, self.config)

    @property
    def root(self) -> str:
        return f"{self.config.uri}/{self.name}"

    @property
    def path(self) -> str:
        return f"{self.root}/{self.split}"

    # schema and metadata

    def set_schema(self, schema: Schema) -> None:
        self.files.write_text(f"{self.root}/schema.json", schema.json())

    def get_schema(self) -> Schema | None:
        path = f"{self.root}/schema.json"
        return Schema.from_json(self.files.read_text(path)) if self.files.exists(path) else None

    def set_metadata(self, metadata: dict) -> None:
        self.files.write_text(f"{self.root}/metadata.json", json.dumps(metadata, indent=1))

    def get_metadata(self) -> dict:
        path = f"{self.root}/metadata.json"
        return json.loads(self.files.read_text(path)) if self.files.exists(path) else {}

    # reading

    def frame(self) -> DataFrame:
        """All rows, lazily. A split that isn't there, or has no file, gives an empty frame of the declared columns.

        Ground truth of several conditions and metrics is never mixed: get_neighbors() reads one of them.
        """
        if self.split not in WRITABLE and len(conditions := self.files.folders(self.path)) > 1:
            raise ValueError(f"{self.path} holds ground truth of {len(conditions)} conditions and metrics; get_neighbors() reads one")
        return self._all()

    def _all(self) -> DataFrame:
        schema = self.get_schema()
        if not any(p.endswith(".parquet") for p, _ in self.files.files(self.path)):
            log.warning("%s has no files", self.path)
            return self.spark.createDataFrame([], schema.struct() if schema and self.split in WRITABLE else "id bigint")
        return self.spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(self.path)

    def read(self, mode: str = "stream", batch_size: int | None = 1000):
        """mode "frame" gives a DataFrame, "full" one pandas frame, "stream" pandas frames of one row, "batch" of batch_size.

        Batches have exactly batch_size rows, whatever the files; the last may be short. "full" holds all rows in the driver.
        """
        if mode not in ("frame", "full", "stream", "batch"):
            raise ValueError("mode is frame, full, stream or batch")
        if mode == "batch" and (batch_size is None or batch_size < 1):
            raise ValueError("batch_size must be positive")
        df = self.frame()
        if mode == "frame":
            return df
        return df.toPandas() if mode == "full" else batches(df, 1 if mode == "stream" else batch_size)

    # writing

    def write(self, data, mode: str = "append", verify_schema: bool = True, *, target_file_size_mb: float = 512) -> None:
        """Adds rows, or puts them in place of those that are there, after they are checked against the schema.

        Rows of train are checked, those of test not. An overwrite that fails leaves the rows that were there.
        """
        DatasetWriter(self, target_file_size_mb=target_file_size_mb).write(data, mode, verify_schema and self.split == "train")

    def get_writer(self, mode: str = "append", **options) -> DatasetWriter:
        return DatasetWriter(self, mode=mode, **options)

    # statistics

    def summary(self) -> dict:
        found = [(p, n) for p, n in self.files.files(self.path) if p.endswith(".parquet")]
        df = self._all()
        return {
            "name": self.name,
            "split": self.split,
            "size": sum(n for _, n in found),
            "size_text": f"{sum(n for _, n in found) / 1048576:.3f} MB",
            "num_rows": df.count() if found else 0,
            "num_columns": len(df.columns) if found else 0,
            "schema": {f.name: f.dataType.simpleString() for f in df.schema} if found else {},
            "storage_type": self.config.type.value,
            "num_files": len(found),
        }

    def get_features(self) -> dict[str, str]:
        return self.summary()["schema"]

    def get_num_rows(self) -> int:
        return self._all().count()

    def get_total_rows(self, split: str | None = None) -> int:
        return Dataset(self.name, split or self.split, config=self.config, spark=self.spark).get_num_rows()

    def get_num_columns(self) -> int:
        return self.summary()["num_columns"]

    def get_size(self) -> int:
        return self.summary()["size"]

    def get_num_files(self) -> int:
        return self.summary()["num_files"]

    def __repr__(self) -> str:
        return f"Dataset({self.name!r}, {self.split!r}, root={self.config.uri!r})"


def batches(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """df's rows in the driver, size at a time, one partition in memory after another."""
    columns, rows = df.columns, []
    for row in df.toLocalIterator(prefetchPartitions=True):
        rows.append(tuple(row))
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def estimate_rows_per_file(sample: DataFrame, files: Files, folder: str, target_mb: float, step: int = 10_000) -> int:
    """Rows of a Parquet file of about target_mb, by writing up to step rows; at least step, a multiple of it.

    The sample is of the layout only; no row is lost or left out by it.
    """
    at = f"{folder}/.estimate-{uuid.uuid4().hex}"
    try:
        head = sample.limit(step)
        head.coalesce(1).write.parquet(at)
        n, size = head.count(), sum(s for p, s in files.files(at) if p.endswith(".parquet"))
    finally:
        files.delete(at)
    return step if not n or not size else max(step, round(target_mb * 1048576 / (size / n) / step) * step)


class DatasetWriter:
    """Writes rows as files of about target_file_size_mb; also a context manager."""

    def __init__(self, dataset: Dataset, mode: str = "append", target_file_size_mb: float = 512):
        if mode not in ("append", "overwrite"):
            raise ValueError("mode is append or overwrite")
        if target_file_size_mb <= 0:
            raise ValueError("target_file_size_mb must be positive")
        self.dataset, self.mode, self.target = dataset, mode, target_file_size_mb
        self._rows: int | None = None

    def __enter__(self) -> DatasetWriter:
        return self

    def __exit__(self, *_) -> None:
        pass  # each write is whole when it returns

    def frame(self, data, schema: Schema) -> DataFrame:
        """data, which is a Spark or pandas frame, an Arrow table, a dict of columns or a list of rows, as a Spark frame."""
        spark = self.dataset.spark
        if isinstance(data, DataFrame):
            return data
        if isinstance(data, pa.Table):
            return spark.createDataFrame(data)
        if isinstance(data, dict):
            sizes = {len(v) for v in data.values()}
            if len(sizes) > 1:
                raise ValueError("columns have unequal lengths")
            data = [dict(zip(data, row)) for row in zip(*data.values())]
        elif isinstance(data, pd.DataFrame):
            data = data.to_dict("records")
        elif not isinstance(data, list):
            raise TypeError(f"{type(data).__name__} can't be written")
        plain = [{k: v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()} for row in data]
        names = {k: None for row in plain for k in row}
        own = [f.to_struct_field() for f in schema.fields if f.name in names]
        if {f.name for f in own} == set(names) or not plain:
            from pyspark.sql.types import StructType

            return spark.createDataFrame(plain, StructType(own if plain else list(schema.struct())))
        known = {f.name: f for f in own}
        rest = spark.createDataFrame([{k: v for k, v in row.items() if k not in known} or {"_": None} for row in plain]).schema
        from pyspark.sql.types import StructType

        return spark.createDataFrame(plain, StructType([*own, *(f for f in rest if f.name not in known)]))

    def write(self, data, mode: str | None = None, verify_schema: bool = True) -> None:
        mode = mode or self.mode
        d = self.dataset
        if mode not in ("append", "overwrite"):
            raise ValueError("mode is append or overwrite")
        if d.split not in WRITABLE:
            raise ValueError(f"{d.split} can't be written; {', '.join(WRITABLE)} can")
        schema = d.get_schema()
        if schema is None:
            raise ValueError("set_schema() comes first")
        try:
            df = self.frame(data, schema)
        except (TypeError, ValueError, pa.ArrowInvalid) as e:
            raise validate.InvalidRows(str(e)) from e
        except Exception as e:  # Spark's own errors for values of a wrong type
            if "Pyspark" in type(e).__name__ or "PySpark" in type(e).__name__:
                raise validate.InvalidRows(str(e)) from e
            raise
        # What is checked, measured and written are the same rows, whatever the input does when it runs again.
        df = cut(df)
        if verify_schema:
            validate.check(df, schema)
            df = validate.conform(df, schema)
        if self._rows is None:
            d.files.make(d.root)
            self._rows = estimate_rows_per_file(df, d.files, d.root, self.target)
        # Few rows in many partitions would make small files.
        files = max(1, -(-df.count() // self._rows))
        out = df.coalesce(files).write.option("maxRecordsPerFile", self._rows)
        if mode == "append":
            out.mode("append").parquet(d.path)
            return
        fresh, old = f"{d.root}/.new-{uuid.uuid4().hex}", f"{d.root}/.old-{uuid.uuid4().hex}"
        out.parquet(fresh)
        if d.files.exists(d.path):
            d.files.rename(d.path, old)
        d.files.rename(fresh, d.path)
        if d.files.exists(old):
            d.files.delete(old)


class DatasetDict(dict):
    """The splits of a dataset."""

    @property
    def _first(self) -> Dataset:
        if "train" not in self:
            raise KeyError("train")
        return self["train"]

    @property
    def name(self) -> str:
        return self._first.name

    def set_schema(self, schema: Schema) -> None:
        self._first.set_schema(schema)

    def summary(self) -> dict[str, dict]:
        return {k: d.summary() for k, d in self.items()}

    to_dict = summary

    def summary_frame(self) -> DataFrame:
        """(split, num_rows, num_columns)."""
        return split_summary({k: d._all() for k, d in self.items()})

    def __repr__(self) -> str:
        return json.dumps(self.summary(), indent=1)

    def compute_neighbors(self, vector_field_name: str, pk_field_name: str = "id", query_expr: str | None = None, top_k: int = 1000, metric_type: str = "cosine", **options) -> DataFrame:
        """Finds the ground truth of test in the rows of train for which query_expr holds, writes it, and reads it."""
        found = knn_.neighbours(self["test"].frame(), self["train"].frame(), vector=vector_field_name, pk=pk_field_name, k=top_k, where=query_expr, metric=metric_type, **options)
        found.orderBy(pk_field_name).write.mode("overwrite").parquet(self._truth(query_expr, metric_type))
        return self.get_neighbors(query_expr, metric_type)

    def _truth(self, where: str | None, metric: str) -> str:
        return f"{self._first.root}/neighbors/{neighbors_name(where, metric)}"

    def get_neighbors(self, query_expr: str | None = None, metric_type: str = "cosine") -> DataFrame:
        """(pk, neighbors_id) as computed before for that condition and metric; raises FileNotFoundError if it wasn't."""
        path = self._truth(query_expr, metric_type)
        if not self._first.files.exists(path):
            raise FileNotFoundError(path)
        return self._first.spark.read.parquet(path)

    def save(self, destination: StorageConfig) -> DataFrame:
        """Copies the dataset, with its schema and metadata, to another store; a report. Raises if a file can't be copied."""
        report = storage.copy(self._first.spark, self._first.config, destination, path=self.name, ignore=("/.new-", "/.old-", "/.estimate-"))
        storage.raise_failed(report)
        return report

    def export(self, sink, *, mode: str = "insert", batch_rows: int = 1000, destination: StorageConfig | None = None) -> int:
        """Sends train to a vector database; see vecloom.sources.export."""
        from vecloom.sources import export

        return export.send(self, sink, mode=mode, batch_rows=batch_rows, destination=destination)


def load_dataset(name: str, split: str | list[str] | None = None, schema: Schema | None = None):
    """A Dataset for one split's name; a DatasetDict for a list of names, or for all splits if there is none."""
    if isinstance(split, str):
        one = Dataset(name, split)
        if schema:
            one.set_schema(schema)
        return one
    out = DatasetDict((s, Dataset(name, s)) for s in (split or SPLITS))
    if schema:
        next(iter(out.values())).set_schema(schema)
    return out


def list_datasets() -> list[dict]:
    """Names and metadata of all datasets in the store."""
    config = get_config()
    names = Files(config.spark, config.storage).folders(config.storage.uri)
    return [{"name": n, "metadata": Dataset(n).get_metadata()} for n in names if not n.startswith((".", "_"))]
