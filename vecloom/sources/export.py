"""Loading train into a vector database through an interface that clients implement."""

from __future__ import annotations

import threading
import time
from abc import ABC, abstractmethod
from collections import defaultdict

import numpy as np

from vecloom.schema import Schema
from vecloom.sources.storage import Files, StorageConfig


class VectorSink(ABC):
    """A client of a vector database. It is pickled to the workers, where connect() comes before insert()."""

    @abstractmethod
    def connect(self) -> None: ...

    @abstractmethod
    def create_collection(self, name: str, schema: Schema) -> None: ...

    @abstractmethod
    def insert(self, name: str, rows: list[dict]) -> int: ...

    @abstractmethod
    def bulk_import(self, name: str, files: list[str]) -> str:
        """The id of an import job."""

    def import_state(self, job: str) -> tuple[str, str]:
        """("running" | "done" | "failed", reason)."""
        return "done", ""

    @abstractmethod
    def search(self, name: str, vectors: list[list[float]], k: int) -> list[list[int]]: ...

    @abstractmethod
    def count(self, name: str) -> int: ...


class MemorySink(VectorSink):
    """Rows in this process's memory, for tests and benchmarks; only for the "import" and local uses of insert()."""

    _rows: dict[tuple[str, str], list[dict]] = defaultdict(list)
    _lock = threading.Lock()

    def __init__(self, space: str = "default", pk: str = "id", vector: str = "embedding"):
        self.space, self.pk, self.vector = space, pk, vector

    def connect(self) -> None:
        pass

    def create_collection(self, name: str, schema: Schema) -> None:
        with self._lock:
            self._rows[self.space, name] = []

    def insert(self, name: str, rows: list[dict]) -> int:
        with self._lock:
            own = self._rows[self.space, name]
            own += [{self.pk: len(own) + k, **r} for k, r in enumerate(rows)]
        return len(rows)

    def bulk_import(self, name: str, files: list[str]) -> str:
        import pyarrow.parquet as pq

        for f in files:
            self.insert(name, pq.read_table(f.removeprefix("file:").replace("//", "/")).to_pylist())
        return files[0]

    def search(self, name: str, vectors: list[list[float]], k: int) -> list[list[int]]:
        rows = self._rows[self.space, name]
        x = np.array([r[self.vector] for r in rows], float)
        ids = np.array([r[self.pk] for r in rows])
        return [ids[np.lexsort((ids, ((x - np.array(v)) ** 2).sum(1)))[:k]].tolist() for v in vectors]

    def count(self, name: str) -> int:
        return len(self._rows[self.space, name])


class FolderSink(VectorSink):
    """Rows as Parquet files in a folder that all workers reach, so that inserts from workers arrive; searches read them all.

    Each insert is a file of its own, which is there when it is whole.
    """

    def __init__(self, folder: str, pk: str = "id", vector: str = "embedding"):
        self.folder, self.pk, self.vector = folder, pk, vector

    def _open(self):
        import pyarrow.fs as fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def _files(self, name: str):
        import pyarrow.fs as fs

        where, root = self._open()
        found = where.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True))
        return where, [f.path for f in found if f.path.endswith(".parquet")]

    def connect(self) -> None:
        self._open()

    def create_collection(self, name: str, schema: Schema) -> None:
        where, root = self._open()
        where.create_dir(f"{root}/{name}", recursive=True)
        where.delete_dir_contents(f"{root}/{name}")

    def insert(self, name: str, rows: list[dict]) -> int:
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        where, root = self._open()
        where.create_dir(f"{root}/{name}", recursive=True)
        at = f"{root}/{name}/{uuid.uuid4().hex}"
        with where.open_output_stream(f"{at}.part") as f:
            pq.write_table(pa.Table.from_pylist(rows), f)
        where.move(f"{at}.part", f"{at}.parquet")
        return len(rows)

    def bulk_import(self, name: str, files: list[str]) -> str:
        import pyarrow.parquet as pq

        for f in files:
            self.insert(name, pq.read_table(f.removeprefix("file:").replace("//", "/")).to_pylist())
        return files[0]

    def search(self, name: str, vectors: list[list[float]], k: int) -> list[list[int]]:
        import pyarrow.parquet as pq

        where, files = self._files(name)
        rows = [r for f in sorted(files) for r in pq.read_table(f, filesystem=where).to_pylist()]
        ids = np.array([r.get(self.pk, at) for at, r in enumerate(rows)])
        x = np.array([r[self.vector] for r in rows], float)
        return [ids[np.lexsort((ids, ((x - np.array(v)) ** 2).sum(1)))[:k]].tolist() if rows else [] for v in vectors]

    def count(self, name: str) -> int:
        import pyarrow.parquet as pq

        where, files = self._files(name)
        return sum(pq.read_metadata(f, filesystem=where).num_rows for f in files)


def insert_frame(df, sink: VectorSink, name: str, batch_rows: int = 1000) -> int:
    """Sends df from the workers in batches; the number of rows that the sink took. A failed task fails the job.

    A task that is run again sends its rows again, so that sinks should replace rows by primary key.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")

    def run(batches):
        sink.connect()
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                total += sink.insert(name, batch.slice(at, batch_rows).to_pylist())
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    return df.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def send(datasets, sink: VectorSink, *, mode: str = "insert", batch_rows: int = 1000, destination: StorageConfig | None = None, poll_seconds: float = 1.0) -> int:
    """Loads train: row by row from the workers ("insert"), or by import jobs over copied files ("import")."""
    if mode not in ("insert", "import"):
        raise ValueError("mode is insert or import")
    train = datasets["train"]
    schema = train.get_schema()
    if schema is None:
        raise ValueError("the dataset has no schema")
    sink.connect()
    sink.create_collection(datasets.name, schema)
    if mode == "insert":
        return insert_frame(train.frame(), sink, datasets.name, batch_rows)
    if destination is None:
        raise ValueError("an import needs a destination that the database can read")
    datasets.save(destination)
    files = [p for p, _ in Files(train.spark, destination).files(f"{destination.uri}/{datasets.name}/train") if p.endswith(".parquet")]
    jobs = [sink.bulk_import(datasets.name, [f]) for f in files]
    failed = []
    while jobs:
        states = {j: sink.import_state(j) for j in jobs}
        failed += [f"{j}: {why}" for j, (state, why) in states.items() if state == "failed"]
        jobs = [j for j in jobs if states[j][0] == "running"]
        if jobs:
            time.sleep(poll_seconds)
    if failed:
        raise RuntimeError(f"{len(failed)} imports failed: {'; '.join(failed)}")
    return sink.count(datasets.name)
