"""Saved tables that are replaced without ever being gone.

A write puts a new version beside those that are there and then switches: one small manifest, renamed into place last, says
which versions hold the table. A writer that dies before that leaves the table as it was. Manifests are numbered, and a
number can be taken once, so of two writers that began from the same state the second is refused. Readers go by the
latest manifest. A version is deleted when two later manifests lack it, so a reader that began before a switch can end.

A table with keys has a folder per key value; a write replaces the folders it writes and leaves all others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FOLDER = "_manifests"


class ConcurrentWrite(RuntimeError):
    """Another writer replaced the table since this one began."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/{FOLDER}") if n.endswith(".json")]


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    files, place = _files(spark, f"{path}/{FOLDER}/{number:020d}.json")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the latest manifest, 0 if there is none, and the version that holds each part."""
    numbers = _numbers(spark, path)
    return (numbers[-1], _manifest(spark, path, numbers[-1])) if numbers else (0, {})


def _switch(spark: SparkSession, path: str, number: int, parts: dict[str, str]) -> bool:
    """Put a manifest in place, whole or not at all; False if its number is taken."""
    files, draft = _files(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    files.mkdirs(draft.getParent())
    out = files.create(draft, False)
    out.write(json.dumps(parts, sort_keys=True).encode())
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FOLDER}/{number:020d}.json")
    jvm = spark._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, plain)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _parts(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Key folders below a version, as relative paths."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{n}".lstrip("/") for f in found for n in _names(spark, f"{path}/{f}" if f else path) if "=" in n]
    return found


def write(df: DataFrame, path: str, kind: str, keys: tuple[str, ...] = (),
          finish: Callable[[str], None] | None = None, **options) -> None:
    """Replace the table, or the key folders that ``df`` has rows for.

    ``finish`` gets the written version's folder before the switch, say to add an index to it.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    number, before = latest(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(*keys) if keys else writer).save(f"{path}/{version}")
    if finish is not None:
        finish(f"{path}/{version}")
    own = dict.fromkeys(_parts(spark, f"{path}/{version}", len(keys)), version)
    if not _switch(spark, path, number + 1, {**before, **own} if keys else own):
        files, place = _files(spark, f"{path}/{version}")
        files.delete(place, True)
        raise ConcurrentWrite(f"{path} was replaced by another writer")
    _forget(spark, path, number)


def _forget(spark: SparkSession, path: str, oldest: int) -> None:
    """Delete manifests before ``oldest`` and the versions that only these name; what no manifest ever named stays."""
    numbers = _numbers(spark, path)
    versions = {n: set(_manifest(spark, path, n).values()) for n in numbers}
    kept = set().union(*(versions[n] for n in numbers if n >= oldest))
    for n in (n for n in numbers if n < oldest):
        for version in versions[n] - kept:
            files, place = _files(spark, f"{path}/{version}")
            files.delete(place, True)
        files, place = _files(spark, f"{path}/{FOLDER}/{n:020d}.json")
        files.delete(place, False)


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str, **options) -> DataFrame:
    """The table as its latest manifest has it; a folder or file without any manifest is read as it is."""
    path = path.rstrip("/")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    number, parts = latest(spark, path)

    def load(places: list[str], base: str | None) -> DataFrame:
        reader = spark.read.schema(schema).format(kind).options(**options)
        return (reader.option("basePath", base) if base else reader).load(places).select(schema.fieldNames())

    if not number:
        return load([path], None)
    found = spark.createDataFrame([], schema)
    for version in sorted(set(parts.values())):
        base = f"{path}/{version}"
        found = found.unionByName(load([f"{base}/{p}" if p else base for p, v in parts.items() if v == version], base))
    return found
