"""Stored tables with a key that are updated in place.

A table is a folder: rows in buckets by a hash of the key, and a small file for each version that names each bucket's folder.
A change is joined with the buckets it touches and no others; these are written anew, and then the version's file appears under
its final name, at once. Readers see the version before or after, never part of a change; a failed write leaves the old version.
Of two writers that began with one version the second one's file is there already: its change is applied again to the new one.

Keys may be null and are unique. Changes with repeated keys need `latest`, the column whose greatest value counts; without it
they raise. Columns that a change doesn't name stay. Old versions' folders stay until drop_old().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.run import work_folder

#: How often a change is applied anew because another one came first.
TRIES = 5


class Conflict(Exception):
    """Another writer has made this version."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    @classmethod
    def create(cls, rows: DataFrame, keys: list[str], path: str | None = None, buckets: int = 16) -> KeyedTable:
        spark = rows.sparkSession
        table = cls(spark, path or f"{work_folder(spark)}/table")
        if table.version() is not None:
            raise Conflict(f"there is a table in {table.path}")
        head = {"version": 0, "keys": keys, "buckets": buckets, "fields": rows.schema.json(), "parts": {}, "batches": []}
        table._once(rows, keys)
        table._commit(head | {"parts": table._write(rows, head)})
        return table

    # versions

    def version(self) -> int | None:
        """The number of the last version."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=None)

    def head(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if n is None:
            raise ValueError(f"there is no table in {self.path}")
        lines = self.spark.read.text(f"{self.path}/versions/{n:012d}.json", wholetext=True).first()[0]
        return json.loads(lines)

    def _commit(self, head: dict) -> None:
        """Makes a version: under a name of its own first, then under its final one unless that is there."""
        temp = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        gateway, rename = self.spark.sparkContext._gateway, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self._files.rename(temp, self._at(f"versions/{head['version']:012d}.json"), gateway.new_array(rename, 0))
        except Exception as error:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {head['version']} is there") from error
            raise

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        head = self.head(version)
        return self._rows(head, sorted(head["parts"]))

    def _schema(self, head: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(head["fields"]))

    def _rows(self, head: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/rows/{head['parts'][b]}/_bucket={b}" for b in buckets if b in head["parts"]]
        schema = self._schema(head)
        # each path is a folder of one bucket, so its name is no column
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, head: dict, side: str = "") -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"{side}{k}") for k in head["keys"])), F.lit(head["buckets"])).cast("int")

    def _write(self, rows: DataFrame, head: dict) -> dict:
        """Rows by bucket, in a folder of their own; which buckets there are."""
        name = uuid.uuid4().hex
        made = rows.withColumn("_bucket", self._bucket(head))
        made.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/rows/{name}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"rows/{name}"))]
        return {n.split("=", 1)[1]: name for n in names if n.startswith("_bucket=")}

    def _once(self, rows: DataFrame, keys: list[str]) -> None:
        if not rows.groupBy(*keys).count().filter("count > 1").limit(1).isEmpty():
            raise ValueError(f"repeated keys {keys}")

    # changes

    def merge(self, changes: DataFrame, assign: dict[str, Column] | None = None, insert: bool = True, latest: str | None = None, batch: str | None = None) -> int:
        """Joins changes (keys and other columns) and returns the version's number.

        assign: what columns become, over the structs `old` and `new` (old is null for a new row); by default the changes'
        columns. insert: whether keys that aren't there become rows. batch: a name; a batch that was applied isn't applied again.
        """
        keys = self.head()["keys"]
        if latest:
            others = [c for c in changes.columns if c not in keys]
            changes = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), latest).alias("_x")).select(*keys, "_x.*")
        else:
            self._once(changes, keys)
        fields = set(changes.columns)

        def apply(head: dict) -> tuple[list[str], DataFrame]:
            names = [f.name for f in self._schema(head)]
            touched = [str(r[0]) for r in changes.select(self._bucket(head).alias("b")).distinct().collect()]  # a number for each bucket at most
            old = self._rows(head, touched).select(F.struct(*names).alias("old"))
            new = changes.select(F.struct(*changes.columns).alias("new"))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
            both = old.join(new, same, "full" if insert else "left")
            found, is_new = F.col("new").isNotNull(), F.col("old").isNull()

            def value(name: str) -> Column:
                was = F.col(f"old.{name}")
                if name in keys:
                    return F.when(is_new, F.col(f"new.{name}")).otherwise(was)
                if assign is not None and name in assign:
                    return F.when(found, assign[name]).otherwise(was)
                if name not in fields:
                    return was
                given = F.col(f"new.{name}")
                return F.when(found if assign is None else is_new, given).otherwise(was)

            return touched, both.select(*(value(n).cast(t).alias(n) for n, t in self._kinds(head)))

        return self._apply(apply, batch)

    def update(self, where: Column, assign: dict[str, Column], batch: str | None = None) -> int:
        """Sets columns (over the row's own) of the rows where the condition holds."""

        def apply(head: dict) -> tuple[list[str], DataFrame]:
            rows = self.read(head["version"])
            touched = [str(r[0]) for r in rows.filter(where).select(self._bucket(head).alias("b")).distinct().collect()]  # a number for each bucket at most
            if set(assign) & set(head["keys"]):
                raise ValueError("keys can't be set")
            own = self._rows(head, touched)
            return touched, own.select(*(F.when(where, assign[n]).otherwise(F.col(n)).cast(t).alias(n) if n in assign else F.col(n) for n, t in self._kinds(head)))

        return self._apply(apply, batch)

    def _kinds(self, head: dict) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self._schema(head)]

    def _apply(self, change: Callable[[dict], tuple[list[str], DataFrame]], batch: str | None) -> int:
        for _ in range(TRIES):
            head = self.head()
            if batch is not None and batch in head["batches"]:
                return head["version"]
            touched, rows = change(head)
            if not touched:
                return head["version"]
            parts = {b: name for b, name in head["parts"].items() if b not in touched} | self._write(rows, head)
            try:
                self._commit(head | {"version": head["version"] + 1, "parts": parts, "batches": head["batches"] + [batch] * (batch is not None)})
                return head["version"] + 1
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other changes came first")

    def drop_old(self) -> None:
        """Deletes what only earlier versions need. Readers of these fail."""
        head = self.head()
        live = set(head["parts"].values())
        for status in self._fs.listStatus(self._at("rows")):
            if status.getPath().getName() not in live:
                self._fs.delete(status.getPath(), True)
        for n in range(head["version"]):
            self._fs.delete(self._at(f"versions/{n:012d}.json"), False)
