"""Immutable layers: raw bytes, normalized events, curated bars.

A snapshot is a folder named by its content's hash: partitioned Parquet and a manifest. It is written beside its place
and renamed into it, so readers see all of it or nothing; writing the same content again changes nothing. Rows that
break rules go, with all rows of their stream, to a quarantine folder, and so do all copies of a repeated event_id.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import digest
from tidemark.operators import book
from tidemark.operators.checks import ValidationError, duplicates, strict, violations
from tidemark.operators.quality import sequence_breaks
from tidemark.sources.schemas import conform, rules, schema
from tidemark.sources.shared import drop_folder, file_system, move_into_place, written

STREAM = ["source", "instrument_id", "session_id"]
#: Columns that number rows as they came in; the first one that all frames have is the order of arrival.
ORDINALS = ("ingest_ordinal", "delivery_id")
#: Kinds that share one sequence.
BOOK = ("book_snapshot", "book_delta")
#: Ordinals, and microseconds of receipt, of a stream that one task checks.
SLICE, SLICE_US = 1 << 20, 1 << 30
PARTITION = ["provider", "venue", "event_type", "date", "instrument"]


def _put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, at = file_system(spark, path)
    stream = fs.create(at, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise ValidationError(f"nothing at {path}")
    return spark.read.text(path, wholetext=True).first()[0]


def content_id(df: DataFrame) -> str:
    """sha256- and the first 16 digits of a hash of the rows, whatever their order, and of the schema."""
    return _identity(_sums(df, ()), df.schema)[0]


def _cell(value: Column, kind: T.DataType) -> Column:
    """Text of a value that tells any two values of its type apart, and ends where it ends."""
    if isinstance(kind, T.StringType):
        text = F.concat(F.length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.unix_micros(value).cast("string"), F.lit(","))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.unix_date(value).cast("string"), F.lit(","))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("("), *[_cell(value[f.name], f.dataType) for f in kind], F.lit(")"))
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = F.concat(value.cast("string"), F.lit(","))
    else:
        json_text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        text = F.concat(F.length(json_text).cast("string"), F.lit(":"), json_text)
    return F.when(value.isNull(), "-").otherwise(text)


_PARTS = [f"s{i}" for i in range(4)]


def _sums(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, rows, sums) in one pass: SHA-256 of each row, four 64-bit parts drawn from it, added up for each partition."""
    row = F.sha2(F.concat(*[_cell(F.col(f.name), f.dataType) for f in sorted(df.schema, key=lambda f: f.name)]), 256)
    sums = [F.sum(F.xxhash64(F.lit(i), "_h").cast("decimal(20,0)")).cast("decimal(38,0)").alias(p) for i, p in enumerate(_PARTS)]
    return df.select(*by, row.alias("_h")).groupBy(*by).agg(F.count("*").alias("rows"), *sums)


def _identity(sums: DataFrame, kind: T.StructType) -> tuple[str, int]:
    """Id and number of rows of what all partitions add up to."""
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.sum(p).cast("decimal(38,0)").alias(p) for p in _PARTS]).first()
    text = json.dumps([[f.name, f.dataType.simpleString()] for f in sorted(kind, key=lambda f: f.name)])
    values = [total.rows, *[total[p] for p in _PARTS]]
    return "sha256-" + hashlib.sha256((text + json.dumps([str(x) for x in values])).encode()).hexdigest()[:16], total.rows


def write_snapshot(df: DataFrame, root: str, *, manifest: dict | None = None, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), allow_empty: bool = False) -> str:
    """Id of a snapshot of df under root. The rows are written once; hashing reads what was written, partition by partition.

    Rows are gathered by partition, and a partition that holds much more than others is written by several tasks, as
    several files, each sorted.
    """
    spark = df.sparkSession
    staging = f"{root}/.staging-{uuid.uuid4().hex}"
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    writer = rows.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{staging}/data")
    back = _data(spark, f"{staging}/data", df.schema)
    _sums(back, partition_by).write.parquet(f"{staging}/sums")
    name, count = _identity(_stored_sums(spark, staging, df.schema, partition_by), df.schema)
    if not count and not allow_empty:
        drop_folder(spark, staging)
        raise ValidationError("an empty snapshot")
    facts = {"id": name, "rows": count, "schema": json.loads(df.schema.json()), "partition_by": list(partition_by), **(manifest or {})}
    _put_text(spark, f"{staging}/manifest.json", json.dumps(facts, sort_keys=True, default=str))
    if not move_into_place(spark, staging, f"{root}/{name}"):  # the same content is there
        drop_folder(spark, staging)
    return name


def _data(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in kind])).parquet(path).select(*kind.names)


def _stored_sums(spark: SparkSession, place: str, kind: T.StructType, by: tuple[str, ...]) -> DataFrame:
    fields = [T.StructField(c, kind[c].dataType) for c in by] + [T.StructField("rows", T.LongType())] + [T.StructField(p, T.DecimalType(38, 0)) for p in _PARTS]
    return spark.read.schema(T.StructType(fields)).parquet(f"{place}/sums")


def manifest_of(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads(_read_text(spark, f"{root}/{name}/manifest.json"))


def read_snapshot(spark: SparkSession, root: str, name: str, *, verify: bool = True, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """The rows of an explicit snapshot, of its partitions for which ``where`` holds (a condition on partition columns).

    ``verify`` counts and hashes them first, and no others. Columns and further filters reach the files.
    """
    facts = manifest_of(spark, root, name)
    kind, by = T.StructType.fromJson(facts["schema"]), tuple(facts["partition_by"])
    rows, sums = _data(spark, f"{root}/{name}/data", kind), _stored_sums(spark, f"{root}/{name}", kind, by)
    if verify and _identity(sums, kind)[0] != name:
        raise ValidationError(f"content of {name} has changed")
    if where:
        rows, sums = rows.where(where), _chosen(sums, by, where)
    if verify and not _differing(sums, _sums(rows, by)).isEmpty():
        raise ValidationError(f"content of {name} has changed")
    return rows.select(*columns) if columns else rows


def _chosen(sums: DataFrame, by: tuple[str, ...], where: str) -> DataFrame:
    sums.select(*by).where(where)  # raises if another column is named
    return sums.where(where)


def _differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two frames holds; null equals null."""
    return one.exceptAll(other).unionByName(other.exceptAll(one))


def query_snapshot(rows: DataFrame, *, columns: list[str] | None = None, start=None, end=None, symbols: list[str] | None = None, as_of=None, date: str = "date", symbol: str = "symbol", available: str = "available_at") -> DataFrame:
    """Projection and filters: dates inclusive, symbols in a set (an empty one selects nothing), known at as_of."""
    if start is not None:
        rows = rows.where(F.col(date) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(date) < F.date_add(F.lit(end).cast("date"), 1))
    if symbols is not None:
        rows = rows.where(F.col(symbol).isin(symbols)) if symbols else rows.limit(0)
    if as_of is not None:
        rows = rows.where(F.col(available) <= F.lit(as_of))
    return rows.select(*columns) if columns else rows


def write_raw(spark: SparkSession, root: str, *, source: str, request: str, collected_at: str, payload: bytes, key: str | None = None) -> str:
    """Exact bytes under their hash, with a manifest; an idempotency key may not be used again for other bytes."""
    sha = hashlib.sha256(payload).hexdigest()
    fs, place = file_system(spark, f"{root}/raw/{sha}")
    claim = f"{root}/claims/{hashlib.sha256(key.encode()).hexdigest()}.json" if key else None
    if claim and fs.exists(file_system(spark, claim)[1]):
        if json.loads(_read_text(spark, claim))["sha256"] != sha:
            raise ValidationError("idempotency key was used for other bytes")
        return sha
    if not fs.exists(place):
        stream = fs.create(file_system(spark, f"{root}/raw/{sha}/payload")[1], False)
        stream.write(bytearray(payload))
        stream.close()
        _put_text(spark, f"{root}/raw/{sha}/manifest.json", json.dumps({"source": source, "request": request, "collected_at": collected_at, "bytes": len(payload), "sha256": sha}, sort_keys=True))
    if claim:
        _put_text(spark, claim, json.dumps({"sha256": sha}))
    return sha


def read_raw(spark: SparkSession, root: str, sha: str) -> bytes:
    payload = bytes(spark.read.format("binaryFile").load(f"{root}/raw/{sha}/payload").select("content").first()[0])
    if hashlib.sha256(payload).hexdigest() != sha:
        raise ValidationError("raw bytes have changed")
    return payload


def missing_references(references: DataFrame, manifests: DataFrame) -> DataFrame:
    """Lineage references (sha256) without a raw object."""
    return references.join(manifests, "sha256", "left_anti")


def _arrived(frames: dict[str, DataFrame], arrival: str | None) -> tuple[dict[str, DataFrame], int]:
    """Frames of their schema's columns and the ordinal, with _at to order them by, and the slice of _at for one task.

    Frames without an ordinal are in order of receipt; what was received at one instant is in order of sequence.
    """
    name = arrival or next((c for c in ORDINALS if all(c in df.columns for df in frames.values())), None)
    if name is None:
        return {k: conform(df, k).withColumn("_at", F.unix_micros("received_at")) for k, df in frames.items()}, SLICE_US
    return {k: conform(df, k, ordinal=name).withColumn("_at", F.col(name).cast("long")) for k, df in frames.items()}, SLICE


def _order_faults(frames: dict[str, DataFrame], width: int) -> DataFrame:
    """(STREAM, reason): sequences that do not advance as rows came in, deltas that do not follow the row before, rows without their place in that order."""
    rows = None
    for kind, df in frames.items():
        before = F.col("previous_sequence") if kind == "book_delta" else F.lit(None).cast("bigint")
        part = df.select(*STREAM, F.lit("book" if kind in BOOK else kind).alias("_domain"), "_at", "sequence", "event_id", before.alias("previous_sequence"))
        rows = part if rows is None else rows.unionByName(part)
    gaps = sequence_breaks(rows.where("_at is not null"), [*STREAM, "_domain"], "_at", width, ["sequence", "event_id"]).select(*STREAM, F.lit("sequence").alias("reason"))
    return gaps.unionByName(rows.where("_at is null").select(*STREAM, F.lit("no_arrival").alias("reason")))


def _without(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the known; null is a key like others."""
    return rows.alias("e").join(known.alias("r"), [F.col(f"e.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left_anti")


def _replay_faults(frames: dict[str, DataFrame], known: DataFrame, group: int) -> DataFrame:
    """(STREAM, reason) of books that break when replayed, of streams without other faults."""
    rows = None
    for kind in BOOK:
        if kind in frames:
            part = frames[kind].withColumn("kind", F.lit(kind))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if "book_delta" not in frames:
        rows = rows.withColumns({c: F.lit(None).cast(schema("book_delta")[c].dataType) for c in ("side", "action", "price", "quantity", "previous_sequence")})
    return book.replay(_without(rows, known, STREAM), group=group).where("violation is not null").select(*STREAM, F.concat(F.lit("replay:"), "violation").alias("reason"))


def check_events(events: DataFrame, kind: str, *, arrival: str | None = None, beside: dict[str, DataFrame] | None = None, group: int = 1) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with reasons) of events: all rows of a stream that one row breaks, and every copy of a repeated event_id.

    Streams are checked with the copies in, and again without them: a copy alone takes out no other row, but a book that
    lacks it may break. Sequences must advance in the order in which rows came in: of the column ``arrival``, else of an
    ordinal (ORDINALS) that the frame has, else of received_at. beside: frames of other kinds that share the streams,
    checked with them and not returned. Snapshots and deltas are one sequence, and are replayed once snapshots are there
    (group as in book.replay); deltas alone are checked for their own chain only.
    """
    frames, width = _arrived({kind: events, **(beside or {})}, arrival)
    own = frames[kind].drop("_at")
    broken = [violations(df, rules(k), STREAM).select(*STREAM, F.concat(F.lit("rule:"), "rule").alias("reason")) for k, df in frames.items()]
    by_stream = lambda df: written(df.groupBy(*STREAM).agg(F.array_sort(F.collect_set("reason")).alias("reasons")), "reasons")  # noqa: E731  a few rule names a stream
    more = lambda known, df: by_stream(known.select(*STREAM, F.explode("reasons").alias("reason")).unionByName(df))
    reasons = by_stream(reduce(DataFrame.unionByName, [*broken, _order_faults(frames, width)]))
    if "book_snapshot" in frames:
        reasons = more(reasons, _replay_faults(frames, reasons, group))
    ids = reduce(DataFrame.unionByName, [df.select("event_id") for df in frames.values()]).where("event_id is not null")
    twice = written(duplicates(ids, ["event_id"]).select("event_id"), "repeated")
    books = [k for k in frames if k in BOOK]
    if books and not twice.isEmpty():  # what is left of other kinds still advances, and rules are of single rows
        rest = {k: _without(frames[k], reasons, STREAM).join(twice, "event_id", "left_anti") for k in books}
        reasons = more(reasons, _order_faults(rest, width))
        if "book_snapshot" in rest:
            reasons = more(reasons, _replay_faults(rest, reasons, group))
    good = _without(own, reasons, STREAM).join(twice, "event_id", "left_anti").select(*own.columns)
    e = own.alias("e").join(reasons.alias("r"), [F.col(f"e.{k}").eqNullSafe(F.col(f"r.{k}")) for k in STREAM], "left").join(twice.withColumn("_twice", F.array(F.lit("repeated_event_id"))).alias("t"), F.col("e.event_id") == F.col("t.event_id"), "left")
    none = F.array().cast("array<string>")
    bad = e.where("r.reasons is not null or t._twice is not null").select("e.*", F.concat(F.coalesce("t._twice", none), F.coalesce("r.reasons", none)).alias("reasons"))
    return good, bad


def write_normalized(events: DataFrame, root: str, kind: str, *, provider: str, venue: Column | str, references: list[str], on_violation: str = "quarantine", arrival: str | None = None, beside: dict[str, DataFrame] | None = None, group: int = 1) -> tuple[str, str | None]:
    """(snapshot id, quarantine id or None) of events, partitioned by provider, venue, type, date and instrument.

    arrival, beside and group as in check_events; deltas are not written without the snapshots of their books beside.
    'fail' refuses everything on any violation instead. Identifiers that an earlier snapshot under root claimed with
    other content are refused.
    """
    if kind == "book_delta" and "book_snapshot" not in (beside or {}):
        raise ValidationError("deltas are checked with the snapshots of their books")
    good, bad = check_events(events, kind, arrival=arrival, beside=beside, group=group)
    bad = written(bad, "rejected")
    if on_violation == "fail":
        strict(bad.select(*STREAM, "event_id", "reasons"), "normalized events")
    quarantine = None if bad.isEmpty() else write_snapshot(bad, f"{root}/quarantine", manifest={"provider": provider, "kind": kind})
    place = F.lit(venue) if isinstance(venue, str) else venue
    rows = good.withColumns({"provider": F.lit(provider), "venue": place, "date": F.col("trading_day"), "instrument": F.col("instrument_id")})
    rows = written(rows, "accepted")
    claims = event_claims(rows, kind)
    known = claimed(events.sparkSession, root)
    if known is not None:
        strict(claim_conflicts(claims, known), "identifiers claimed before")
    name = write_snapshot(rows, f"{root}/normalized", manifest={"provider": provider, "kind": kind, "references": sorted(references)}, partition_by=tuple(PARTITION), sort_by=("event_time", "sequence", "event_id"))
    claims.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{root}/claims/{name}")
    return name, quarantine


def event_claims(rows: DataFrame, kind: str) -> DataFrame:
    """(event_id_hash, event_id, event_sha256, claim_sha256, shard) of each event: what an identifier stands for."""
    c = rows.select("event_id", digest(schema(kind).names).alias("event_sha256")).withColumn("event_id_hash", F.sha2("event_id", 256))
    return c.withColumn("claim_sha256", digest(["event_id_hash", "event_id", "event_sha256"])).withColumn("shard", F.substring("event_id_hash", 1, 2))


def claimed(spark: SparkSession, root: str) -> DataFrame | None:
    fs, at = file_system(spark, f"{root}/claims")
    if not fs.exists(at):
        return None
    return spark.read.schema("event_id_hash string, event_id string, event_sha256 string").option("recursiveFileLookup", "true").parquet(f"{root}/claims")


def claim_conflicts(new: DataFrame, known: DataFrame) -> DataFrame:
    """Identifiers that stand for other content in another snapshot."""
    k = known.select("event_id_hash", F.col("event_id").alias("_id"), F.col("event_sha256").alias("_sha"))
    return new.join(k, "event_id_hash").where("event_id <> _id or event_sha256 <> _sha").select("event_id", "event_sha256", F.col("_sha").alias("claimed_sha256"))


def claim_shards(claims: DataFrame) -> DataFrame:
    """(shard, rows, total, mixed): order-independent sums and xors of claim hashes of each shard."""
    part = lambda i, n: F.conv(F.substring("claim_sha256", i * n + 1, n), 16, 10)
    return claims.groupBy("shard").agg(F.count("*").alias("rows"), *[F.sum(part(i, 16).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"total{i}") for i in range(4)], *[F.bit_xor(part(i, 8).cast("long")).alias(f"mixed{i}") for i in range(8)])


def partition_manifest(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, first, last, logical hash parts) of each partition, in one aggregation."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def write_curated(bars: DataFrame, root: str, *, dataset: str, revision: str, recipe: str, inputs: list[str], event_bars: bool = False) -> str:
    """Bars by date and instrument (event bars also by source and session), each revision once."""
    keys = ("trading_day", "instrument_id") + (("source", "session_id") if event_bars else ())
    doubled = {f"p_{k}": F.col(k) for k in keys}
    spark, place = bars.sparkSession, f"{root}/curated/{dataset}"
    register = f"{place}/revisions/{revision}.json"
    fs, at = file_system(spark, register)
    name = write_snapshot(bars.withColumns(doubled), place, manifest={"dataset": dataset, "revision": revision, "recipe": recipe, "inputs": sorted(inputs)}, partition_by=tuple(doubled), sort_by=("bar_start",))
    if fs.exists(at):
        if json.loads(_read_text(spark, register))["id"] != name:
            raise ValidationError(f"revision {revision} exists with other content")
    else:
        _put_text(spark, register, json.dumps({"id": name}))
    return name


def catalog_entry(df: DataFrame, name: str, *, date: str = "date", symbol: str = "symbol") -> DataFrame:
    return df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_distinct(symbol).alias("symbols"), F.min(date).alias("first"), F.max(date).alias("last"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(id, rows, columns, partition_by, manifest) of each snapshot under root, by its manifest."""
    fs, at = file_system(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    facts = [manifest_of(spark, root, n) for n in names if n.startswith("sha256-")]  # one small file a snapshot
    rows = [(m["id"], m["rows"], [f["name"] for f in m["schema"]["fields"]], m["partition_by"], json.dumps(m, sort_keys=True)) for m in facts]
    return spark.createDataFrame(rows, "id string, rows long, columns array<string>, partition_by array<string>, manifest string")


def summary(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, distinct): what a snapshot holds, in one pass; distinct is approximate."""
    fields = [f for f in df.schema if not isinstance(f.dataType, T.MapType)]
    per = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"), F.approx_count_distinct(F.xxhash64(f"`{f.name}`")).alias("distinct")) for f in fields]
    return df.agg(F.array(*per).alias("_s")).select(F.inline("_s"))
