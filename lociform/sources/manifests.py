"""Reuse of written tables: a manifest tells from which inputs, parameters and code a table was made.

A table's folder is named after its fingerprint, so that a changed input makes a new table beside the old one,
which its readers keep.  The manifest is written after the table: what was interrupted has none and is made again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, text: str) -> list[tuple[str, int, int]]:
    """(name, size, time of change) of every file of an input, whatever the store; marks of writers do not count."""
    path, system = _path(spark, text)
    if not system.exists(path):
        raise FileNotFoundError(f"input {text} is not there")
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            found.append((name, f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict | None, version: str) -> str:
    """SHA-256 of the inputs' state, the parameters and the version of the code that reads them."""
    told = {"inputs": [state_of(spark, i) for i in inputs], "parameters": parameters or {}, "version": version}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def _text(spark: SparkSession, name: str) -> str | None:
    path, system = _path(spark, name)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def reused(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], inputs: list[str], version: str, parameters: dict | None = None) -> DataFrame:
    """The table of that name, read if one of the same fingerprint was finished, else built, written and read.

    folder is one that the driver and all executors share.
    """
    own = fingerprint(spark, inputs, parameters, version)
    place = f"{folder.rstrip('/')}/{name}/{own}"
    known = _text(spark, f"{place}/manifest.json")
    if known is None:
        # two runs at once write beside each other; the last manifest names a whole table either way
        table = f"{place}/table-{uuid.uuid4().hex}"
        made = build()
        made.write.parquet(table)
        known = json.dumps({"name": name, "fingerprint": own, "inputs": inputs, "parameters": parameters or {}, "version": version, "table": table, "schema": made.schema.json(), "created": int(time.time() * 1000)}, default=str)
        path, system = _path(spark, f"{place}/manifest-{uuid.uuid4().hex}")
        out = system.create(path, True)
        out.write(bytearray(known.encode()))
        out.close()
        final, _ = _path(spark, f"{place}/manifest.json")
        system.delete(final, False)
        system.rename(path, final)
    return spark.read.parquet(json.loads(known)["table"])


def history(spark: SparkSession, folder: str, name: str) -> list[dict]:
    """The manifests of a table's versions, the oldest first."""
    path, system = _path(spark, f"{folder.rstrip('/')}/{name}")
    if not system.exists(path):
        return []
    found = [_text(spark, s.getPath().toString() + "/manifest.json") for s in system.listStatus(path)]
    return sorted((json.loads(f) for f in found if f), key=lambda m: m["created"])
