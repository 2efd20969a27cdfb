"""Intermediate tables that outlive a lost executor.

``materialize`` writes a DataFrame to the folder that the cluster shares and reads it back: lineage ends there,
later scans prune columns, and values that depend on task placement (row ids, partition ids) stay fixed.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: Folders chosen here for applications that set none, by application id.
_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` if set, else a local one in local mode or the warehouse."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            _own[app] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
            _made.append((spark, _own[app]))
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marginalia"
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; dropped by ``discard`` or ``scratch``, or else when
    the driver's Python ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Drop tables that ``materialize`` returned; nothing that is still to be computed may read them."""
    for t in tables:
        _made.remove((t.sparkSession, t.table_path))
        drop(t.sparkSession, t.table_path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops the tables that are made inside at its end, but for those given to the function it yields."""
    before, kept = set(_made), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add((table.sparkSession, table.table_path))
        return table

    yield keep
    for spark, path in [m for m in _made if m not in before and m not in kept and m[1] not in _own.values()]:
        _made.remove((spark, path))
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with ``text``; False, and nothing done, if it is there.

    The text is written beside its place and then renamed, which fails where the name is taken: of several writers one
    wins, no reader meets half of it, and a writer that dies on the way takes no name.
    """
    jvm = spark.sparkContext._jvm
    fs, target = _file(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    replace_nothing = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), replace_nothing)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, target = _file(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, target = _file(spark, path)
    source = fs.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


@atexit.register
def drop_all() -> None:
    """Remove every table made here; a stopped session leaves nothing that could be asked."""
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the JVM is gone; its scratch folder is the cluster's to expire
            return
