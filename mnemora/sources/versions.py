"""Versioned tables: new files beside the old ones, made current by one atomic rename.

A table is a folder of data folders and of manifests ``_manifest/<version>.json``; the manifest of the highest version
says which data folder holds each slice.  A reader that began before keeps reading the old files; a writer that dies
leaves files that no manifest names.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Manifest:
    """The manifests of one table, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict[str, Any]]:
        """The current version and its content; version 0 and nothing for a new table."""
        versions = self._versions()
        if not versions:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.path}/_manifest/{versions[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return versions[-1], json.loads(text)

    def commit(self, version: int, content: dict[str, Any]) -> None:
        """Make ``content`` current; fails if another writer committed this version first."""
        temporary = self._path(f"{self.path}/_manifest/.{version}.tmp")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if version in self._versions() or not self._fs.rename(temporary, self._path(f"{self.path}/_manifest/{version}.json")):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")
