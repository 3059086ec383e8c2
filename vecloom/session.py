"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once a context: a zip in the shared folder, added to the job.

    Queries do this by themselves; programs that call operators in a session of their own call it first.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vecloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # not when the package itself runs from a zip that was shipped already
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(root)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root))), open(path, "rb").read())
        data = held.getvalue()
        name = f"vecloom-{hashlib.sha256(data).hexdigest()[:16]}.zip"
        files = SharedFiles(spark, f"{shared_dir(spark)}/vecloom")
        if not files.exists(name):
            files.write_bytes(name, data)
        sc.addPyFile(f"{shared_dir(spark)}/vecloom/{name}")
    sc._vecloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own; on a cluster a missing
    setting is an error, since a machine-local path would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = os.path.join(tempfile.gettempdir(), f"vecloom-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


_made: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, gone at the latest when the program ends."""
    path = f"{shared_dir(spark)}/vecloom/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_at_exit)
    _made.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written to the shared folder inside: results must have been written or collected by then."""
    before = len(_made)
    try:
        yield
    finally:
        _remove(spark, before)


def _remove(spark: SparkSession, since: int = 0) -> None:
    gone, _made[since:] = _made[since:], []
    for path in gone:
        SharedFiles(spark, path).delete("")


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        with suppress(Exception):  # the session may be on its way out
            _remove(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, loss of executors harmless."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SharedFiles:
    """Small file operations on the shared folder through Hadoop's file system, whatever its scheme."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name) if name else self._root

    def names(self, below: str = "") -> list[str]:
        path = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, name: str) -> int:
        """Bytes below a folder, 0 if there is none."""
        return int(self._fs.getContentSummary(self._path(name)).getLength()) if self.exists(name) else 0

    def uri(self) -> str:
        """The folder as a URI that Python's file systems read, wherever a task runs."""
        full = self._fs.makeQualified(self._root).toString()
        scheme, _, rest = full.partition(":")
        return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://" + (rest if scheme == "file" else rest.lstrip("/"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        self.write_bytes(name, text.encode())

    def write_bytes(self, name: str, data: bytes) -> None:
        """Appears whole or not at all: written aside, then renamed."""
        aside = self._path(f"{name}.tmp-{uuid.uuid4().hex[:8]}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(data))
        stream.close()
        if not self._fs.rename(aside, self._path(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(name)
