"""Tables in versions: what a reader has begun to read stays as it is, whatever is written meanwhile.

A table is a folder.  Rows lie in ``data``, in a folder for each write and below
it one for each part (the value of a column, such as a range of blocks).
``versions`` holds a small file for each version, which names the folders that
make up each part.  A write puts its rows where no version looks, and then makes
the next version's file under its own name, by a rename that fails where another
writer was first.  So a version is there whole or not at all; a write that dies
leaves rows that nobody reads, until ``vacuum`` takes them away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.checkpoints import removed

#: Times that a write begins anew where another one has been first.
TRIES = 20
_PART = "__part"


class Conflict(RuntimeError):
    """Another writer has made the same version."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType | None
    parts: dict[int, list[str]]  # folders below ``data``


class Versioned:
    """The table in a folder, whose rows lie by the whole number in the column ``by``."""

    def __init__(self, spark: SparkSession, folder: str, by: str) -> None:
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by

    # versions

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):  # noqa: ANN202
        return self._path("versions").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The versions that are there, in order."""
        system, place = self._system(), self._path("versions")
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, or the last one; one without rows where none has been written."""
        numbers = self.numbers()
        if number is None and not numbers:
            return Version(-1, None, {})
        number = numbers[-1] if number is None else number
        told = json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/versions/{number:012d}.json", 1).first()[1])
        return Version(number, T.StructType.fromJson(told["schema"]), {int(k): v for k, v in told["parts"].items()})

    def _commit(self, after: Version, schema: T.StructType, parts: dict[int, list[str]]) -> Version:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        new = Version(after.number + 1, schema, parts)
        own, name = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{new.number:012d}.json")
        system = self._system()
        system.mkdirs(self._path("versions"))
        out = system.create(own, True)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "parts": parts}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(own, name, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            system.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.number} is there already") from e
            raise
        return new

    # reading

    def rows(self, number: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows of a version, or of its parts from low to high; other parts are not opened."""
        return self._read(self.version(number), lambda k: (low is None or k >= low) and (high is None or k <= high))

    def _read(self, version: Version, wanted: Callable[[int], bool]) -> DataFrame:
        paths = [f"{self.folder}/data/{p}" for k, places in sorted(version.parts.items()) if wanted(k) for p in places]
        if version.schema is None:
            raise FileNotFoundError(f"no version in {self.folder}")
        return self.spark.read.schema(version.schema).parquet(*paths) if paths else self.spark.createDataFrame([], version.schema)

    # writing

    def _write(self, df: DataFrame) -> dict[int, list[str]]:
        """Puts rows into a folder of their own; the parts that they make."""
        name = uuid.uuid4().hex
        df.withColumn(_PART, F.col(self.by)).write.partitionBy(_PART).parquet(f"{self.folder}/data/{name}")
        system, place = self._system(), self._path(f"data/{name}")
        made = [f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()]
        return {int(n.partition("=")[2]): [f"{name}/{n}"] for n in made if n.startswith(_PART)}

    def _tried(self, step: Callable[[Version], Version]) -> Version:
        for _ in range(TRIES):
            try:
                return step(self.version())
            except Conflict:
                continue
        raise Conflict(f"other writers were first {TRIES} times")

    def overwrite(self, df: DataFrame) -> Version:
        """A version of these rows alone."""
        new = self._write(df)
        return self._tried(lambda last: self._commit(last, df.schema, new))

    def append(self, df: DataFrame) -> Version:
        """A version with these rows besides."""
        new = self._write(df)

        def step(last: Version) -> Version:
            parts = {k: last.parts.get(k, []) + new.get(k, []) for k in {*last.parts, *new}}
            return self._commit(last, last.schema or df.schema, parts)

        return self._tried(step)

    def put(self, rows: DataFrame, key: str) -> Version:
        """A version in which these rows are in the place of those with the same key; only their parts are written."""
        touched = {r[0] for r in rows.select(self.by).distinct().collect()}

        def step(last: Version) -> Version:
            old = self._read(last, touched.__contains__)
            new = self._write(old.join(rows.select(key), key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))
            return self._commit(last, last.schema, {k: v for k, v in last.parts.items() if k not in touched} | new)

        return self._tried(step)

    def compact(self, most: int = 1) -> Version:
        """A version with the same rows, whose parts lie in one folder each where they lay in more than ``most``."""

        def step(last: Version) -> Version:
            many = {k for k, places in last.parts.items() if len(places) > most}
            if not many:
                return last
            return self._commit(last, last.schema, last.parts | self._write(self._read(last, many.__contains__)))

        return self._tried(step)

    def vacuum(self, keep: int = 2) -> None:
        """Takes away all but the last ``keep`` versions and the rows that none of those holds; nobody may be writing."""
        numbers, system = self.numbers(), self._system()
        used = {p for n in numbers[-keep:] for places in self.version(n).parts.values() for p in places}
        held = {p.partition("/")[0] for p in used}
        for n in numbers[:-keep]:
            removed(self.spark, f"{self.folder}/versions/{n:012d}.json")
        place = self._path("data")
        for write in system.listStatus(place) if system.exists(place) else []:
            name = write.getPath().getName()
            if name not in held:
                system.delete(write.getPath(), True)
                continue
            for part in system.listStatus(write.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in used:
                    system.delete(part.getPath(), True)

