"""Rows that are written once for each key, whatever runs again or beside."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyLedger:
    """A folder of rows by key (a period, a repository's state), each key there once whatever runs again: rows lie under
    data/<name of a write>, and a key counts from the moment its own ledger entry, which names the write, is created.
    Creating a file that must not exist is atomic, so of two runs that write a key one enters it and the other's rows
    are never read."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("period_start",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def entries(self) -> DataFrame:
        """(_write, _key): which write holds each key; _key is the key as JSON."""
        fs, path = self._fs(f"{self.path}/ledger")
        if not fs.exists(path):
            return self.spark.createDataFrame([], "_write string, _key string")
        lines = self.spark.read.schema("write string, key string").option("pathGlobFilter", "*.json").json(f"{self.path}/ledger")
        return lines.where("write is not null").select(F.col("write").alias("_write"), F.col("key").alias("_key"))

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in self.keys)), {"ignoreNullFields": "false"}))

    def add(self, df: DataFrame) -> int:
        """Writes the rows of the keys that the ledger lacks; returns how many keys it has entered."""
        rows = self._keyed(df).join(self.entries().select("_key").distinct(), "_key", "left_anti")
        write = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{write}")
        new = self.spark.read.parquet(f"{self.path}/data/{write}").select("_key").distinct()
        entered = 0
        for r in new.toLocalIterator():  # a key a row
            name = hashlib.sha256(r["_key"].encode()).hexdigest()
            fs, path = self._fs(f"{self.path}/ledger/{name}.json")
            try:
                out = fs.create(path, False)
            except Py4JJavaError as e:
                if "Exist" not in e.java_exception.getClass().getSimpleName():
                    raise
                continue  # another run has entered it meanwhile
            out.write(bytearray(json.dumps({"write": write, "key": r["_key"]}).encode() + b"\n"))
            out.close()
            entered += 1
        return entered

    def read(self, schema) -> DataFrame:
        """The rows of all entered keys."""
        fs, path = self._fs(f"{self.path}/data")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        kept = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/data")
        kept = self._keyed(kept).withColumn("_write", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return kept.join(self.entries(), ["_write", "_key"], "left_semi").drop("_write", "_key")
