"""Tables in the folder that all executors share.

Intermediate results that are read more than once are written there, which cuts the lineage and survives the loss of
an executor.  The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is made only
where that setting is absent and all work is done on one machine, as in tests.  What an application wrote is in a folder
of its own, which is deleted as it ends.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, without a slash at its end."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="mnemora-")
        base = "file://" + _LOCAL[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # with its scheme, as workers read some tables themselves
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted as the driver ends."""
    folder = f"{shared_dir(spark)}/mnemora/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of this application that nothing reads any more."""
    _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote for the moment; results that were not written yet can't be read any more."""
    _delete(spark, own_folder(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for as long as the application runs."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table; lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Parts:
    """The files of a table in the shared folder, in the order of their names, for tasks that read it themselves."""

    def __init__(self, path: str):
        from pyarrow import fs

        self._fs, root = fs.FileSystem.from_uri(path)
        found = self._fs.get_file_info(fs.FileSelector(root, allow_not_found=True))
        self._files = sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".parquet"))

    def tables(self, columns: list[str], first: int = 0, end: int | None = None):
        """One Arrow table for each of the files from ``first`` on, before ``end``."""
        import pyarrow.parquet as pq

        for path in self._files[first:end]:
            with self._fs.open_input_file(path) as file:
                yield pq.ParquetFile(file).read(columns=columns)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, unless their Python path has it anyway."""
    parent = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    paths = {*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()}
    if app in _SHIPPED or str(parent) in paths:
        return
    _SHIPPED.add(app)
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted((parent / "mnemora").rglob("*.py")):
            archive.write(file, file.relative_to(parent))
    path = f"{own_folder(spark)}/mnemora_package.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(made.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
