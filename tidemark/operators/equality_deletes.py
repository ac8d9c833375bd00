"""A table kept as insert files and equality-delete files with sequence numbers.

A change is appended, never applied in place: an upsert writes an insert row and a delete row of its key, a delete
writes only the delete row, and a snapshot writes one delete row for the whole book besides its inserts. A reader
keeps the insert rows for which no delete row of the same key has a greater sequence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed import fixed_e8, packed, packed_high, packed_low
from tidemark.functions.text import plain
from tidemark.sources.shared import file_system, place, shared_folder, written

BOOK = ["instrument_id", "source", "session_id"]
LEVEL = [*BOOK, "side", "price_e8"]


class EqualityDeleteTable:
    """Commits below one folder, each with insert/, delete/ (keys of levels) and reset/ (keys of books) files.

    A commit is written beside its place and renamed into it, so a reader, or a writer that is lost, never shows a
    change's deletes without its inserts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_folder(spark, "equality-deletes")
        book = "instrument_id string, source string, session_id string"
        self.schemas = {
            "insert": f"{book}, side string, price_e8 long, sequence long, quantity_e8 long",
            "delete": f"{book}, side string, price_e8 long, sequence long",
            "reset": f"{book}, sequence long",
        }
        self.fs, at = file_system(spark, self.path)
        self.fs.mkdirs(at)

    def _commits(self) -> list[str]:
        names = [s.getPath().getName() for s in self.fs.listStatus(file_system(self.spark, self.path)[1])]
        return [f"{self.path}/{n}" for n in names if n.startswith("commit-")]

    def _commit(self, **kinds: DataFrame) -> None:
        name = uuid.uuid4().hex[:12]
        for kind, rows in kinds.items():
            rows.write.parquet(f"{self.path}/.{name}/{kind}")
        place(self.spark, f"{self.path}/.{name}", f"{self.path}/commit-{name}")

    def _read(self, kind: str) -> DataFrame:
        folders = [f"{c}/{kind}" for c in self._commits() if self.fs.exists(file_system(self.spark, f"{c}/{kind}")[1])]
        return self.spark.read.schema(self.schemas[kind]).parquet(*folders) if folders else self.spark.createDataFrame([], self.schemas[kind])

    def append_changes(self, changes: DataFrame) -> None:
        """Changes of levels. Copies of a change fold into one row; so do, within one append, changes that a later one
        of their key in the same append covers anyhow. Rows without sequence, price or side change no level."""
        clean = changes.select(*BOOK, "sequence", plain(F.col("side")).alias("side"), plain(F.col("action")).alias("action"), fixed_e8(F.col("price")).alias("price_e8"), fixed_e8(F.col("quantity")).alias("quantity_e8"))
        clean = clean.withColumn("sequence", F.col("sequence") * 2)  # a snapshot's place is between its sequence and the next
        clean = clean.where("sequence is not null and price_e8 is not null and side <> ''")
        removes = F.coalesce(F.col("action") == "delete", F.lit(False)) | (F.coalesce("quantity_e8", F.lit(0)) == 0)
        # of equal sequences with unlike content (no such copies are sent) the greater quantity counts, a delete least
        sets = F.when(~removes, packed(F.col("sequence"), F.col("quantity_e8")))
        last = clean.groupBy(*LEVEL).agg(F.max("sequence").alias("sequence"), F.max(sets).alias("_in"))
        rows = written(last, "changes")
        inserts = rows.where("_in is not null").select(*LEVEL, packed_high(F.col("_in")).alias("sequence"), packed_low(F.col("_in")).alias("quantity_e8"))
        self._commit(delete=rows.select(*LEVEL, "sequence"), insert=inserts)

    def append_snapshots(self, snapshots: DataFrame) -> None:
        """Whole books. A snapshot is a delete of its book and inserts of its levels, both at its sequence. Copies fold."""
        known = snapshots.where("sequence is not null").withColumn("sequence", F.col("sequence") * 2 + 1)
        resets = known.groupBy(*BOOK).agg(F.max("sequence").alias("sequence"))
        sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("levels")) for s, c in (("bid", "bids"), ("ask", "asks"))])
        levels = known.select(*BOOK, "sequence", F.inline(sides)).select(*BOOK, "sequence", "side", F.explode("levels").alias("level"))
        rows = levels.select(*BOOK, "side", fixed_e8(F.col("level.price")).alias("price_e8"), "sequence", fixed_e8(F.col("level.quantity")).alias("quantity_e8"))
        rows = rows.where("price_e8 is not null and quantity_e8 <> 0").groupBy(*LEVEL, "sequence").agg(F.max("quantity_e8").alias("quantity_e8"))
        self._commit(reset=resets, insert=rows)

    def read(self) -> DataFrame:
        """(book, side, price_e8, quantity_e8) of the rows no later delete key equals."""
        deletes = self._read("delete").groupBy(*LEVEL).agg(F.max("sequence").alias("_deleted"))
        resets = self._read("reset").groupBy(*BOOK).agg(F.max("sequence").alias("_reset"))
        d, r, i = deletes.alias("d"), resets.alias("r"), self._read("insert").alias("i")
        same = lambda other, keys: [F.col(f"i.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
        left = i.join(d, [*same("d", LEVEL), F.col("d._deleted") > F.col("i.sequence")], "left_anti")
        left = left.join(r, [*same("r", BOOK), F.col("r._reset") > F.col("i.sequence")], "left_anti")
        # one change may have come in several commits
        return left.groupBy(*LEVEL).agg(F.max(packed(F.col("sequence"), F.col("quantity_e8"))).alias("_last")).select(*LEVEL, packed_low(F.col("_last")).alias("quantity_e8"))

    def compact(self) -> None:
        """One commit in place of all so far: the standing inserts, and the last delete and reset of each key, which still hold for changes yet to come."""
        old = self._commits()
        d = self._read("delete").groupBy(*LEVEL).agg(F.max("sequence").alias("sequence"))
        r = self._read("reset").groupBy(*BOOK).agg(F.max("sequence").alias("sequence"))
        i = self._read("insert").groupBy(*LEVEL).agg(F.max(packed(F.col("sequence"), F.col("quantity_e8"))).alias("_last")).select(*LEVEL, packed_high(F.col("_last")).alias("sequence"), packed_low(F.col("_last")).alias("quantity_e8"))
        self._commit(delete=d, reset=r, insert=i)  # with the old ones beside it reads the same
        for c in old:
            self.fs.delete(file_system(self.spark, c)[1], True)


def books_at_end(changes: DataFrame, snapshots: DataFrame, path: str | None = None) -> DataFrame:
    """(instrument_id, source, session_id, side, price_e8, quantity_e8): each level of each book after all its changes.

    Null keys of a book are keys like others; order and repetition of either input change nothing; a book without a
    snapshot starts empty; empty inputs give no rows.
    """
    table = EqualityDeleteTable(changes.sparkSession, path)
    table.append_changes(changes)
    table.append_snapshots(snapshots)
    return table.read()
