"""Content-addressed objects with owners and parents, kept as files and small append-only tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checks import ValidationError
from tidemark.operators.graph import collectable
from tidemark.sources.shared import drop_folder, file_system


class ArtifactStore:
    """objects/SHA, and logs of edges and pins: a row with sign 1 adds, one with sign -1 takes back; the sum tells what holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _log(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")

    def _read(self, name: str, schema: str) -> DataFrame:
        fs, at = file_system(self.spark, f"{self.root}/{name}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def put(self, value: bytes, *, owner: str | None = None, parents: tuple[str, ...] = ()) -> str:
        """Reference of the bytes; the same bytes are held once. parents are kept as long as this object is."""
        ref = hashlib.sha256(value).hexdigest()
        fs, at = file_system(self.spark, f"{self.root}/objects/{ref}")
        if not fs.exists(at):
            part = file_system(self.spark, f"{self.root}/objects/.{ref}-{uuid.uuid4().hex}")[1]
            stream = fs.create(part, False)
            stream.write(bytearray(value))
            stream.close()
            fs.rename(part, at)
        if parents:
            self._log("edges", [(ref, p) for p in parents], "parent string, child string")
        if owner:
            self.retain(owner, [ref])
        return ref

    def get(self, ref: str) -> bytes:
        value = bytes(self.spark.read.format("binaryFile").load(f"{self.root}/objects/{ref}").select("content").first()[0])
        if hashlib.sha256(value).hexdigest() != ref:
            raise ValidationError(f"object {ref} has changed")
        return value

    def retain(self, owner: str, refs: list[str]) -> None:
        self._log("pins", [(owner, r, 1) for r in refs], "owner string, node string, sign int")

    def release(self, owner: str) -> None:
        held = [(owner, r.node, -1) for r in self.pins().where(F.col("owner") == owner).collect()]
        if held:
            self._log("pins", held, "owner string, node string, sign int")

    def pins(self) -> DataFrame:
        rows = self._read("pins", "owner string, node string, sign int")
        return rows.groupBy("owner", "node").agg(F.sum("sign").alias("n")).where("n > 0").select("owner", "node")

    def objects(self) -> DataFrame:
        fs, at = file_system(self.spark, f"{self.root}/objects")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return self.spark.createDataFrame([(n,) for n in names if not n.startswith(".")], "node string")

    def unreferenced(self) -> DataFrame:
        """(node) of objects that no pin keeps, directly or through what it was made from."""
        return collectable(self.objects(), self._read("edges", "parent string, child string"), self.pins().select("node"))

    def collect(self) -> int:
        """Delete what nothing keeps; the number of objects deleted."""
        gone = [r.node for r in self.unreferenced().collect()]
        for ref in gone:
            drop_folder(self.spark, f"{self.root}/objects/{ref}")
        return len(gone)

    def delete(self, ref: str) -> None:
        if self.unreferenced().where(F.col("node") == ref).isEmpty():
            raise ValidationError(f"object {ref} is kept")
        drop_folder(self.spark, f"{self.root}/objects/{ref}")
