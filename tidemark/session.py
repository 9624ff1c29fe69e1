"""Session helpers: where intermediate tables go and how wide a shuffle should be."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only on one machine (master local) and where it is unset a temporary folder is made, and kept
    for the session. On a cluster a machine's own folder would hold a part of each table only, so
    that an unset name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.dir", named)
    return named.rstrip("/")


_open: list[list[str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables that operators made within it: write their results inside."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system it lives on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Publish source as target in one step; fails if target is there already."""
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(dst) or not fs.rename(src, dst):
        raise OSError(f"cannot publish {source} as {target}")


class Versions:
    """A small text that writers replace by compare-and-swap: each version is a file of its own, created only if it is not there yet."""

    KEPT = 10

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self._fs.Path(self.path + ".versions")
        self.fs = self.folder.getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self.folder) if s.getPath().getName().isdigit())

    def read(self) -> tuple[int, str | None]:
        """Number and text of the newest version; (0, None) if there is none."""
        n = max(self._numbers(), default=0)
        if not n:
            return 0, None
        stream = self.fs.open(self._fs.Path(self.folder, f"{n:020d}"))
        try:
            return n, bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, seen: int, text: str) -> bool:
        """Make text the version after `seen`; False if another writer was first."""
        self.fs.mkdirs(self.folder)
        temp, target = self._fs.Path(self.folder, f"_{uuid.uuid4().hex}"), self._fs.Path(self.folder, f"{seen + 1:020d}")
        stream = self.fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.getScheme() == "file":
            # A rename on a local file system takes what is there for granted; a link does not.
            try:
                os.link(temp.toUri().getPath(), target.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            self.fs.delete(temp, False)
        else:
            try:
                none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
                self._fs.FileContext.getFileContext(target.toUri(), self._conf).rename(temp, target, none)
                done = True
            except Exception as e:  # noqa: BLE001 - py4j wraps the one that counts
                if "FileAlreadyExistsException" not in str(e):
                    raise
                self.fs.delete(temp, False)
                done = False
        if done:
            for old in self._numbers()[: -self.KEPT]:
                self.fs.delete(self._fs.Path(self.folder, f"{old:020d}"), False)
        return done
