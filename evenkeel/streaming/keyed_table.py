"""A table with one row per key that a stream keeps up to date, in files that are published at once.

Rows live in buckets of their key. A batch rewrites only the buckets that it has keys of, into a folder of
its own, and then a small list of the current folder of each bucket is published by a rename. Whatever is
lost before the rename leaves the table as it was, and the batch is run again; after it, the batch is known
to be in and a repetition does nothing. Readers take the newest list and see whole batches only.

    path/data/batch=<id>/bucket=<k>/…     the buckets that this batch rewrote
    path/derived/batch=<id>/bucket=<k>/…  what is derived from each of them
    path/lists/<id>.json                  {"batch": id, "data": {bucket: batch of its folder}, "derived": {…}, "note": …}

Batch ids must grow, so a table belongs to one stream and its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

_BUCKET = "bucket"


class Folder:
    """The few file operations that publishing needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self._conf), path

    def names(self, name: str) -> list[str]:
        files, path = self._at(name)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def delete(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)

    def read(self, name: str) -> str:
        files, path = self._at(name)
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_aside(self, name: str, text: str) -> None:
        files, path = self._at(name)
        stream = files.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, source: str, target: str) -> None:
        files, old = self._at(source)
        if not files.rename(old, self._at(target)[1]):
            raise OSError(f"can't publish {self.path}/{target}")


@dataclass(frozen=True)
class KeyedTable:
    """`keys` name a row, `order` says which of two rows of a key is newer, `buckets` split the keys.

    A row with a key that is there already replaces it if its `order` is not lower; late older rows and
    repeated ones change nothing. `spread` are the keys that choose the bucket, by default all of them.

    `derive` makes a table of its own from the rows of a bucket, e.g. sums or candidates. It is made again
    for the buckets that change, and published with them. It gets the rows of several buckets with their
    `bucket` and returns rows with their `bucket`.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str]
    order: Sequence[str]
    buckets: int = 64
    spread: Sequence[str] | None = None
    derive: Callable[[DataFrame], DataFrame] | None = None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.spread or self.keys)), F.lit(self.buckets)).cast("int")

    # Publishing --------------------------------------------------------------------------------------

    def _folder(self) -> Folder:
        return Folder(self.spark, self.path)

    def current(self) -> dict:
        """The newest list: the last batch that is in, and the folder of each bucket."""
        published = [int(n.removesuffix(".json")) for n in self._folder().names("lists") if n.endswith(".json")]
        if not published:
            return {"batch": -1, "data": {}, "derived": {}, "note": None}
        return json.loads(self._folder().read(f"lists/{max(published)}.json"))

    def _publish(self, batch: int, content: dict) -> None:
        folder = self._folder()
        folder.write_aside(f"lists/{batch}.json.part", json.dumps({"batch": batch} | content))
        folder.rename(f"lists/{batch}.json.part", f"lists/{batch}.json")

    def _clean(self) -> None:
        """Remove what neither the newest list nor the one before it names, so that readers can finish."""
        folder = self._folder()
        numbers = sorted(int(n.removesuffix(".json")) for n in folder.names("lists") if n.endswith(".json"))
        lists = [json.loads(folder.read(f"lists/{n}.json")) for n in numbers[-2:]]
        for n in numbers[:-2]:
            folder.delete(f"lists/{n}.json")
        for kind in ("data", "derived"):
            named = {f"batch={b}/{_BUCKET}={k}" for one in lists for k, b in one[kind].items()}
            for batch in folder.names(kind):
                parts = [f"{batch}/{n}" for n in folder.names(f"{kind}/{batch}") if n.startswith(_BUCKET)]
                gone = [n for n in parts if n not in named]
                for n in [batch] if len(gone) == len(parts) else gone:
                    folder.delete(f"{kind}/{n}")

    # Rows --------------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """The rows as last published."""
        return self._rows("data", self.current()["data"], self.schema).select(*self.schema.fieldNames())

    def read_derived(self) -> DataFrame:
        """The derived rows as last published."""
        rows = self.spark.createDataFrame([], self._with_bucket(self.schema))
        schema = StructType([f for f in self.derive(rows).schema.fields if f.name != _BUCKET])
        return self._rows("derived", self.current()["derived"], schema).drop(_BUCKET)

    @staticmethod
    def _with_bucket(schema: StructType) -> StructType:
        return StructType(list(schema.fields)).add(_BUCKET, IntegerType())

    def _rows(self, kind: str, folders: dict, schema: StructType) -> DataFrame:
        """The rows of the listed buckets, with their `bucket`."""
        if not folders:
            return self.spark.createDataFrame([], self._with_bucket(schema))
        paths = [f"{self.path}/{kind}/batch={b}/{_BUCKET}={k}" for k, b in folders.items()]
        number = F.regexp_extract(F.col("_metadata.file_path"), f"/{_BUCKET}=([0-9]+)/", 1).cast("int")
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.select(*schema.fieldNames(), number.alias(_BUCKET))

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key: the greatest in `order`, then in all columns, so that ties don't depend on luck."""
        names = self.schema.fieldNames()
        rest = [n for n in names if n not in self.keys and n not in self.order]
        chosen = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("_newest"))
        return chosen.select(*self.keys, "_newest.*").select(*names)

    def merge(self, batch: DataFrame, batch_id: int, note: object = None) -> None:
        """Take in a batch; if it is in already, nothing happens. A short `note` is published with it."""
        now = self.current()
        if now["batch"] >= batch_id:
            return
        arrived = self.newest(batch.select(*self.schema.fieldNames())).withColumn(_BUCKET, self.bucket())
        touched = sorted(r[0] for r in arrived.select(_BUCKET).distinct().collect())  # `buckets` at most
        changed = {str(k): batch_id for k in touched}
        derived = {k: b for k, b in now["derived"].items() if k not in changed}
        if touched:
            old = self._rows("data", {k: b for k, b in now["data"].items() if k in changed}, self.schema)
            merged = self.newest(old.unionByName(arrived).drop(_BUCKET)).withColumn(_BUCKET, self.bucket())
            self._write("data", merged, batch_id)
        if touched and self.derive is not None:
            self._write("derived", self.derive(self._rows("data", changed, self.schema)), batch_id)
            # A bucket may have nothing to derive, and then has no folder.
            there = self._folder().names(f"derived/batch={batch_id}")
            derived |= {k: batch_id for k in changed if f"{_BUCKET}={k}" in there}
        self._publish(batch_id, {"data": now["data"] | changed, "derived": derived, "note": note})
        self._clean()

    def _write(self, kind: str, rows: DataFrame, batch_id: int) -> None:
        """A large bucket is written by several tasks, a file each."""
        path = f"{self.path}/{kind}/batch={batch_id}"
        rows.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
