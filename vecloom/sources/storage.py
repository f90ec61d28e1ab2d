"""Stores of datasets: local folders and object stores through the file systems of the session."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("vecloom")


class StorageType(str, Enum):
    LOCAL = "local"
    S3 = "s3"
    GCS = "gcs"


_ALIASES = {
    "access_key": ("access_key", "aws_access_key_id", "key"),
    "secret_key": ("secret_key", "aws_secret_access_key", "secret"),
    "endpoint": ("endpoint", "endpoint_url"),
    "region": ("region", "region_name"),
    "token": ("token", "aws_session_token"),
}
_S3 = {"access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "endpoint": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region", "token": "fs.s3a.session.token"}


@dataclass(frozen=True)
class StorageConfig:
    """A root folder, and the options of its file system. Options beginning with "fs." are passed on as they are."""

    type: StorageType
    root_path: str
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "type", StorageType(self.type))

    @property
    def uri(self) -> str:
        bare = self.root_path.split("://", 1)[-1].rstrip("/")
        if self.type is StorageType.LOCAL:
            import os

            return "file://" + os.path.abspath(bare.removeprefix("file:"))
        return f"{'s3a' if self.type is StorageType.S3 else 'gs'}://{bare}"

    def hadoop_options(self) -> dict[str, str]:
        flat = {**self.options, **self.options.get("client_kwargs", {})}
        out = {k: str(v) for k, v in flat.items() if k.startswith("fs.")}
        if self.type is StorageType.S3:
            for name, key in _S3.items():
                for alias in _ALIASES[name]:
                    if flat.get(alias) is not None:
                        out.setdefault(key, str(flat[alias]))
            if "fs.s3a.endpoint" in out:
                out.setdefault("fs.s3a.path.style.access", "true")
        return out


class Files:
    """The file system of a store, by the session's own classes."""

    def __init__(self, spark: SparkSession, config: StorageConfig):
        self.spark, self.config = spark, config
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in config.hadoop_options().items():
            self._conf.set(k, v)

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._path(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._path(old)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} can't be renamed {new}")

    def read_text(self, path: str) -> str:
        fs, p = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._path(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def folders(self, path: str) -> list[str]:
        """The names of the folders in path."""
        fs, p = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def files(self, path: str) -> Iterator[tuple[str, int]]:
        """(path, bytes) of each file in path and the folders in it."""
        fs, p = self._path(path)
        if fs.exists(p):
            found = fs.listFiles(p, True)
            while found.hasNext():
                s = found.next()
                yield s.getPath().toString(), s.getLen()


def check(spark: SparkSession, config: StorageConfig) -> None:
    """Makes the root folder, unless it is there; raises where the store can't be reached."""
    files = Files(spark, config)
    if not files.exists(config.uri):
        files.make(config.uri)


def copy(spark: SparkSession, source: StorageConfig, target: StorageConfig, *, path: str = "", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Copies all files below path, and gives a report (source, destination, status); status is "copied" or the error.

    Paths that contain one of the strings of ignore are left out. Each executor copies its share of the files, as streams.
    Where some can't be copied the others still are; see raise_failed().
    """
    files = Files(spark, source)
    Files(spark, target)
    begin = f"{source.uri}/{path}".rstrip("/")
    goal = f"{target.uri}/{path}".rstrip("/")
    found = [(p, size) for p, size in files.files(begin) if not any(x in p for x in ignore)]
    strip = lambda p: p.split(":", 1)[-1].lstrip("/") if p.startswith("file:") else p
    base = strip(begin)
    rows = [(p, goal + strip(p)[len(base) :], size) for p, size in found]
    if not rows:
        return spark.createDataFrame([], "source string, destination string, status string")
    options = {"source": (source.type.value, dict(source.options)), "target": (target.type.value, dict(target.options))}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    _stream(r["source"], r["destination"], options)
                    out.append({**r, "status": "copied"})
                except Exception as e:  # reported, and raised by raise_failed()
                    out.append({**r, "status": f"failed: {e}"})
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in ("source", "destination", "status")} for x in out], pa.schema([(k, pa.string()) for k in ("source", "destination", "status")]))

    spread = spark.createDataFrame(rows, "source string, destination string, size bigint").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    from vecloom.sources.shared import cut

    return cut(spread.mapInArrow(run, "source string, destination string, status string"))


def _filesystem(path: str, kind: str, options: dict):
    import pyarrow.fs as fs

    flat = {**options, **options.get("client_kwargs", {})}
    pick = lambda name: next((flat[a] for a in _ALIASES[name] if flat.get(a) is not None), None)
    if kind == "s3":
        end = pick("endpoint")
        own = {"access_key": pick("access_key"), "secret_key": pick("secret_key"), "session_token": pick("token"), "region": pick("region"), "endpoint_override": end}
        return fs.S3FileSystem(**{k: v for k, v in own.items() if v is not None}), path.split("://", 1)[1]
    if kind == "gcs":
        own = {k: flat.get(k) for k in ("anonymous", "access_token", "credential_token_expiration", "target_service_account", "project_id")}
        own["project_id"] = own["project_id"] or flat.get("project")
        end = pick("endpoint")
        if end:
            own["scheme"], own["endpoint_override"] = end.split("://", 1) if "://" in end else ("https", end)
        return fs.GcsFileSystem(**{k: v for k, v in own.items() if v is not None}), path.split("://", 1)[1]
    return fs.LocalFileSystem(), "/" + path.split(":", 1)[-1].lstrip("/")


def _stream(source: str, destination: str, options: dict) -> None:
    import posixpath

    (fs_in, a), (fs_out, b) = _filesystem(source, *options["source"]), _filesystem(destination, *options["target"])
    if options["target"][0] == "local":
        fs_out.create_dir(posixpath.dirname(b), recursive=True)
    with fs_in.open_input_stream(a) as x, fs_out.open_output_stream(b) as y:
        while part := x.read(8 << 20):
            y.write(part)


def raise_failed(report: DataFrame) -> None:
    failed = report.where(F.col("status") != "copied").collect()
    if failed:
        raise OSError(f"{len(failed)} files couldn't be copied, first {failed[0].source}: {failed[0].status}")
