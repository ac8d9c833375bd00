"""Values, events, layers, intake, SQL, exchange messages and streams."""

import binascii
import json
import random
from collections import Counter
from datetime import UTC, date, datetime, timedelta
from decimal import ROUND_05UP, ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_DOWN, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import instants, values
from tidemark.operators import book
from tidemark.operators.checks import ValidationError
from tidemark.sources import exchange, intake, lake, schemas
from tidemark.sources.sqlview import SqlView
from tidemark.streaming import capture

T0 = datetime(2024, 3, 4, 10, tzinfo=UTC)
ROUNDED = {"up": ROUND_UP, "down": ROUND_DOWN, "ceiling": ROUND_CEILING, "floor": ROUND_FLOOR, "half_up": ROUND_HALF_UP, "half_down": ROUND_HALF_DOWN, "half_even": ROUND_HALF_EVEN, "05up": ROUND_05UP}


def test_rounding_modes(spark):
    texts = ["1.25", "-1.25", "1.35", "-1.35", "0.05", "2", "-0.01", "1.249", "9.51", "x", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r for r in df.select("t", *[values.fixed_from_text(F.col("t"), 1, m)["units"].alias(m) for m in ROUNDED], values.fixed_from_text(F.col("t"), 1)["units"].alias("exact")).collect()}
    for t in texts:
        for m, mode in ROUNDED.items():
            want = int(Decimal(t).quantize(Decimal("0.1"), mode) * 10) if t and t != "x" else None
            assert got[t][m] == want, (t, m)
        assert got[t].exact == (20 if t == "2" else None)


def test_products_and_hashes(spark):
    big = 2**63 - 1
    fp = "struct<units: bigint, scale: smallint>"
    df = spark.createDataFrame([((big, 18), (big, 0), "b", None, 1)], f"x {fp}, y {fp}, s string, n string, a long")
    r = df.select(values.fixed_product(F.col("x"), F.col("y")).alias("p"), values.fixed_value(F.col("x")).alias("v"), values.canonical_json(["s", "n", "a"]).alias("j"), values.signed_crc32(F.lit("3366.1:7")).alias("c")).first()
    assert (int(r.p.units), r.p.scale) == (big * big, 18) and r.v == Decimal(big).scaleb(-18)
    assert r.j == '{"a":1,"n":null,"s":"b"}'
    crc = binascii.crc32(b"3366.1:7")
    assert r.c == (crc - 2**32 if crc >= 2**31 else crc)


def test_hashes_of_whole_documents(spark, tmp_path):
    import hashlib

    from tidemark.plans import layers

    at = datetime(2024, 3, 4, 10, 0, 0, 123456, tzinfo=UTC)
    base = (1, 'ä "quoted" \\ text\n/ 漢😀', "en", "s", 20, "i", at, at)
    changed = [base, *[(*base[:i], v, *base[i + 1 :]) for i, v in enumerate((2, base[1][:-1] + "😁", "de", "t", 21, None, at + timedelta(microseconds=1), at - timedelta(microseconds=1)))]]
    names = ["doc_id", "text", "lang", "source", "n_chars", "instrument_id", "published_at", "available_at"]
    df = spark.createDataFrame(changed, "doc_id long, text string, lang string, source string, n_chars long, instrument_id string, published_at timestamp, available_at timestamp")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    micros = lambda v: (v - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1) if isinstance(v, datetime) else v
    want = {hashlib.sha256(json.dumps({k: micros(v) for k, v in zip(names, row)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for row in changed}
    assert {r.sha256 for r in layers.document_hashes(spark, str(tmp_path)).collect()} == want and len(want) == 9


def test_instants(spark):
    texts = ["2024-03-04T10:00:00.123456789+02:00", "2024-03-04T10:00Z", "2024-03-04T10:00:00", "2024-03-04T10:00:00.1234567890Z", None, "2024-03-04 10:00:00.5-0530"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(instants.nanos_text(instants.parse_nanos(F.col("t")))).collect()]
    assert got == ["2024-03-04T08:00:00.123456789Z", "2024-03-04T10:00:00Z", None, None, None, "2024-03-04T15:30:00.500000Z"]
    local = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30),), (datetime(2024, 10, 27, 2, 30),), (datetime(2024, 6, 1, 12, 0),)], "t timestamp")
    found = [r[0] for r in local.select(instants.local_to_utc(F.col("t"), "Europe/Berlin")).collect()]
    assert [r.status for r in found] == ["nonexistent", "ambiguous", "exact"] and found[1].at == datetime(2024, 10, 27, 0, 30) and found[2].at == datetime(2024, 6, 1, 10)
    ends = spark.range(1).select(instants.quarter_ends(F.lit("2023-12-31").cast("date"), F.lit("2024-09-29").cast("date"))).first()[0]
    assert ends == [date(2023, 12, 31), date(2024, 3, 31), date(2024, 6, 30)]


def header(kind, i, seq, stream="s"):
    return (kind, f"e{i}", "i", T0 + timedelta(seconds=i), T0 + timedelta(seconds=i), T0 + timedelta(seconds=i), stream, date(2024, 3, 4), "x", seq)


def trades(spark, data):
    return spark.createDataFrame(data, schemas.schema("trade"))


def test_one_bad_row_rejects_its_stream(spark):
    data = [(*header("trade", i, i), (5, 1), (1, 0), "buy") for i in range(3)]
    data += [(*header("trade", 10 + i, i, "bad"), (0 if i == 1 else 5, 1), (1, 0), "buy") for i in range(3)]
    data += [(*header("trade", 20, i, "twice"), (5, 1), (1, 0), "buy") for i in range(2)]
    data += [(*header("trade", 30 + i, 7, "stuck"), (5, 1), (1, 0), "buy") for i in range(2)]
    good, bad = lake.check_events(trades(spark, data), "trade")
    assert {r.event_id for r in good.collect()} == {"e0", "e1", "e2"}
    assert {r.source: r.reasons for r in bad.collect()} == {"bad": ["rule:positive"], "twice": ["repeated_event_id"], "stuck": ["sequence"]}
    with pytest.raises(ValidationError):
        schemas.conform(trades(spark, data).drop("price"), "trade")


def test_sequence_in_order_of_arrival(spark, tmp_path):
    rows = [(*header("trade", i, i), (5, 1), (1, 0), "buy") for i in range(3)]
    late = [(*header("trade", 10 + i, q, "late"), (5, 1), (1, 0), "buy") for i, q in enumerate((1, 3, 2))]
    by_clock = trades(spark, rows + late)  # received a second apart
    ordinal = {f"e{i}": n for n, i in enumerate((0, 1, 2, 10, 12, 11))}  # here the late one is in order
    numbered = trades(spark, rows + late).withColumn("delivery_id", F.create_map(*[F.lit(x) for kv in ordinal.items() for x in kv])[F.col("event_id")])
    backwards = numbered.withColumn("delivery_id", F.when(F.col("source") == "s", -F.col("delivery_id")).otherwise(F.col("delivery_id")))
    for df, want in ((by_clock, {"late"}), (numbered, set()), (backwards, {"s"}), (by_clock.withColumn("delivery_id", F.lit(None).cast("int")), {"s", "late"})):
        good, bad = lake.check_events(df, "trade")
        assert {r.source for r in bad.collect()} == want and {r.source for r in good.collect()} == {"s", "late"} - want
        assert ("delivery_id" in good.columns) == ("delivery_id" in df.columns)
    assert lake.write_normalized(by_clock, f"file://{tmp_path}", "trade", provider="p", venue="v", references=[])[1]
    with pytest.raises(ValidationError):
        lake.check_events(by_clock, "trade", arrival="source")


def test_snapshots_and_deltas_are_one_sequence(spark, tmp_path):
    level = lambda p: ((p, 0), (1, 0), None)
    fp = lambda u: (u, 0)
    snaps = spark.createDataFrame([(*header("book_snapshot", i, 1, n), [level(3)], [level(6)]) for i, n in enumerate(("ok", "gap", "gone", "crossed"))], schemas.schema("book_snapshot"))
    bad = {"gap": (5, 4, "bid", "upsert", 2, 1), "gone": (2, 1, "bid", "delete", 2, 0), "crossed": (2, 1, "bid", "upsert", 6, 1), "ok": (2, 1, "bid", "upsert", 4, 1), "none": (2, 1, "bid", "upsert", 4, 1)}
    data = [(*header("book_delta", i + 10, seq, n), side, action, fp(price), fp(quantity), prev) for i, (n, (seq, prev, side, action, price, quantity)) in enumerate(bad.items())]
    deltas = spark.createDataFrame(data, schemas.schema("book_delta"))
    good, rejected = lake.check_events(deltas, "book_delta", beside={"book_snapshot": snaps})
    assert {r.source for r in good.collect()} == {"ok"}
    assert {r.source: r.reasons for r in rejected.collect()} == {"gap": ["sequence"], "gone": ["replay:absent_level"], "crossed": ["replay:crossed"], "none": ["replay:no_snapshot"]}
    assert {r.source for r in lake.check_events(snaps, "book_snapshot", beside={"book_delta": deltas})[0].collect()} == {"ok"}
    assert lake.check_events(snaps, "book_snapshot")[0].count() == 4
    with pytest.raises(ValidationError):
        lake.write_normalized(deltas, f"file://{tmp_path}", "book_delta", provider="p", venue="v", references=[])
    name, quarantine = lake.write_normalized(deltas, f"file://{tmp_path}", "book_delta", provider="p", venue="v", references=[], beside={"book_snapshot": snaps})
    assert quarantine and lake.manifest_of(spark, f"file://{tmp_path}/normalized", name)["rows"] == 1


def test_repeated_ids_go_row_by_row(spark):
    rows = [(*header("trade", i, i, s), (5, 1), (1, 0), "buy") for s, ids in (("a", (0, 1, 2, 3)), ("b", (1, 4, 5))) for i in ids]
    rows += [(*header("trade", i, q, "again"), (5, 1), (1, 0), "buy") for i, q in ((7, 1), (8, 2), (8, 2), (9, 3))]  # not one id only, but a sequence that stands still
    good, bad = lake.check_events(trades(spark, rows), "trade")
    assert Counter((r.source, r.event_id) for r in good.collect()) == Counter([("a", "e0"), ("a", "e2"), ("a", "e3"), ("b", "e4"), ("b", "e5")])
    assert Counter((r.source, r.event_id, *r.reasons) for r in bad.collect()) == Counter([("a", "e1", "repeated_event_id"), ("b", "e1", "repeated_event_id"), ("again", "e7", "sequence"), *[("again", "e8", "repeated_event_id", "sequence")] * 2, ("again", "e9", "sequence")])


def test_a_book_without_its_repeated_ids_is_checked_again(spark):
    level = lambda p: ((p, 0), (1, 0), None)
    snaps = spark.createDataFrame([(*header("book_snapshot", i, 1, n), [level(3)], [level(6)]) for i, n in enumerate(("ends", "breaks"))], schemas.schema("book_snapshot"))
    data = [(*header("book_delta", i, q, n), "bid", "upsert", (2, 0), (1, 0), q - 1) for n, ids in (("ends", (11, 12, 13)), ("breaks", (3, 13, 23))) for q, i in enumerate(ids, 2)]
    deltas = spark.createDataFrame(data, schemas.schema("book_delta")).withColumns({"ingest_ordinal": F.col("sequence")})
    good, bad = lake.check_events(deltas, "book_delta", beside={"book_snapshot": snaps.withColumn("ingest_ordinal", F.col("sequence"))})
    assert sorted(r.event_id for r in good.collect()) == ["e11", "e12"]
    assert {r.event_id + r.source: r.reasons for r in bad.collect()} == {"e13ends": ["repeated_event_id"], "e3breaks": ["sequence"], "e13breaks": ["repeated_event_id", "sequence"], "e23breaks": ["sequence"]}


def test_normalized_arrivals_against_plain_python(spark, sf):
    import duckdb

    from tidemark.plans import layers, layers_sql

    rows = duckdb.sql(f"select source, instrument_id, session_id, sequence, event_id, {layers_sql._BAD_TRADE} as bad from '{sf}/market_trades.parquet' order by delivery_id").fetchall()
    copies, last, broken = Counter(r[4] for r in rows), {}, set()
    for *stream, sequence, _, bad in rows:
        key = tuple(stream)
        if bad or (key in last and sequence <= last[key]):
            broken.add(key)
        else:
            last[key] = sequence
    want = Counter((r[0], "rejected" if tuple(r[:3]) in broken or copies[r[4]] > 1 else "kept") for r in rows)
    assert {(r.source, r.part): r.n for r in layers.normalized_arrivals(spark, sf).collect()} == want


def test_book_rules(spark):
    level = lambda p, q=1: ((p, 0), (q, 0), None)
    data = [(*header("book_snapshot", 1, 1), [level(3), level(2)], [level(4)]), (*header("book_snapshot", 2, 2), [level(2), level(3)], [level(4)]), (*header("book_snapshot", 3, 3), [level(4)], [level(4)]), (*header("book_snapshot", 4, 4), [], [level(4)])]
    found = schemas.record_violations(spark.createDataFrame(data, schemas.schema("book_snapshot")), "book_snapshot", ["event_id"])
    assert Counter(map(tuple, found.collect())) == Counter([("e2", "ordered"), ("e3", "uncrossed"), ("e4", "ordered"), ("e4", "uncrossed")])
    for kind in [*schemas.EVENTS, *schemas.REFERENCES]:  # every rule is a valid expression
        assert schemas.record_violations(spark.createDataFrame([], schemas.schema(kind)), kind, []).collect() == []


def test_lake_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = trades(spark, [(*header("trade", i, i), (5 + i, 1), (1, 0), "buy") for i in range(20)])
    name, quarantine = lake.write_normalized(rows, root, "trade", provider="p", venue="v", references=["r1"])
    assert quarantine is None
    back = lake.read_snapshot(spark, f"{root}/normalized", name)
    assert back.count() == 20 and lake.manifest_of(spark, f"{root}/normalized", name)["references"] == ["r1"]
    assert lake.write_normalized(rows.repartition(3), root, "trade", provider="p", venue="v", references=["r1"])[0] == name  # the same content again
    changed = rows.withColumn("aggressor_side", F.lit("sell"))
    with pytest.raises(ValidationError):
        lake.write_normalized(changed, root, "trade", provider="p", venue="v", references=[])
    with pytest.raises(ValidationError):
        lake.write_normalized(rows.unionByName(rows.limit(1)), f"{root}/2", "trade", provider="p", venue="v", references=[], on_violation="fail")
    with pytest.raises(ValidationError):
        lake.write_snapshot(rows.limit(0), root)
    claims = lake.event_claims(rows, "trade")
    assert lake.claim_shards(claims).agg(F.sum("rows")).first()[0] == 20
    bars = spark.createDataFrame([(date(2024, 3, 4), "i", T0, 1.0)], "trading_day date, instrument_id string, bar_start timestamp, open double")
    first = lake.write_curated(bars, root, dataset="d", revision="r", recipe="x", inputs=[name])
    assert lake.write_curated(bars, root, dataset="d", revision="r", recipe="x", inputs=[name]) == first
    with pytest.raises(ValidationError):
        lake.write_curated(bars.withColumn("open", F.lit(2.0)), root, dataset="d", revision="r", recipe="x", inputs=[name])
    assert [(r.id, r.rows) for r in lake.listed(spark, f"{root}/normalized").collect()] == [(name, 20)] and lake.listed(spark, f"{root}/nothing").collect() == []
    held = {r["column"]: r for r in lake.summary(rows.select("event_id", F.lit(None).cast("int").alias("x"))).collect()}
    assert {c: (r.rows, r.nulls) for c, r in held.items()} == {"event_id": (20, 0), "x": (20, 20)} and 18 <= held["event_id"]["distinct"] <= 22
    part = next(p for p in (tmp_path / "normalized" / name / "data").rglob("*.parquet"))
    part.unlink()
    with pytest.raises(ValidationError):
        lake.read_snapshot(spark, f"{root}/normalized", name)
    days = spark.range(60).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("day"))
    kept = lake.write_snapshot(days, f"{root}/days", partition_by=("day",), sort_by=("id",))
    assert lake.write_snapshot(days.repartition(5), f"{root}/days", partition_by=("day",)) == kept  # nor does it land inside the first
    for p in (tmp_path / "days" / kept / "data" / "day=2024-01-02").glob("*.parquet"):
        p.unlink()
    assert lake.read_snapshot(spark, f"{root}/days", kept, where="day = '2024-01-01'").count() == 20  # other partitions are not read
    for where in (None, "day >= '2024-01-02'", "id = 1"):
        with pytest.raises(Exception):  # noqa: B017
            lake.read_snapshot(spark, f"{root}/days", kept, where=where)
    sha = lake.write_raw(spark, root, source="s", request="q", collected_at="t", payload=b"\x00bytes", key="k")
    assert lake.read_raw(spark, root, sha) == b"\x00bytes" == lake.read_raw(spark, root, lake.write_raw(spark, root, source="s", request="q", collected_at="t", payload=b"\x00bytes", key="k"))
    with pytest.raises(ValidationError):
        lake.write_raw(spark, root, source="s", request="q", collected_at="t", payload=b"other", key="k")


def test_snapshot_queries(spark):
    df = spark.createDataFrame([(date(2024, 1, d), s, T0 + timedelta(days=d)) for d in (1, 2, 3) for s in "ab"], "date date, symbol string, available_at timestamp")
    assert lake.query_snapshot(df, start=date(2024, 1, 2), end=date(2024, 1, 2), columns=["symbol"]).count() == 2
    assert lake.query_snapshot(df, symbols=["a"], as_of=T0 + timedelta(days=2)).count() == 2
    assert lake.query_snapshot(df, symbols=[]).collect() == []


def replayed(events, group):
    """Plain replay of one stream: (last good sequence, violation)."""
    bids, asks, last = {}, {}, None
    for i, (seq, prev, side, action, price, snap) in enumerate(events):
        if snap is not None:
            bids, asks = dict(snap[0]), dict(snap[1])
        elif last is None:
            return last, "no_snapshot"
        elif prev != last:
            return last, "sequence_gap"
        else:
            levels = bids if side == "bid" else asks
            if action == "delete":
                if price not in levels:
                    return last, "absent_level"
                del levels[price]
            else:
                levels[price] = 1
        last = seq
        inside = group > 1 and i + 1 < len(events) and events[i + 1][0] // group == seq // group
        if not inside and bids and asks and max(bids) >= min(asks):
            return last, "crossed"
    return last, None


@pytest.mark.parametrize("group", [1, 5])
def test_replay(spark, group):
    rnd = random.Random(7)
    data, want = [], {}
    fp = lambda u: (u, 0)
    for s in range(25):
        snap = ({4: 1, 3: 1}, {8: 1, 9: 1})
        events = [(1, None, None, None, None, snap)] if s else []
        for q in range(2, 20):
            events.append((q, q - 1 if rnd.random() > 0.02 else q - 2, rnd.choice(["bid", "ask"]), rnd.choice(["upsert"] * 3 + ["delete"]), rnd.randint(2, 10), None))
        want[str(s)] = replayed(events, group)
        for q, prev, side, action, price, book_ in events:
            levels = [[(fp(p), fp(n), None) for p, n in x.items()] for x in book_] if book_ else [None, None]
            data.append(("src", str(s), "x", "book_snapshot" if book_ else "book_delta", q, T0, f"{q:03d}", side, action, price and fp(price), fp(0 if action == "delete" else 1), prev, *levels))
    f = "struct<units: bigint, scale: smallint>"
    ls = f"array<struct<price: {f}, quantity: {f}, order_count: bigint>>"
    df = spark.createDataFrame(data, f"source string, instrument_id string, session_id string, kind string, sequence long, event_time timestamp, event_id string, side string, action string, price {f}, quantity {f}, previous_sequence long, bids {ls}, asks {ls}")
    got = book.replay(df.repartition(3), checkpoints=(1,), group=group).collect()
    assert {r.instrument_id: (r.sequence, r.violation) for r in got} == want
    again = book.replay(df, checkpoints=(1,), group=group).collect()
    assert {r.instrument_id: r.state_sha256 for r in got} == {r.instrument_id: r.state_sha256 for r in again}
    assert len({r.checkpoints[0].sha256 for r in got if r.checkpoints}) == 24  # the stream's name is part of its state
    assert book.replay(df.limit(0)).collect() == []


def test_intake(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sym,day,px,n\nA,2024-01-02,1.5,3\nA,2024-01-02,x,4.5\n,2024-13-01,,7\n")
    raw = intake.read_delimited(spark, str(tmp_path / "a.csv"))
    contract = intake.Contract({"symbol": ("sym", "string", None), "date": ("day", "date", "yyyy-MM-dd"), "price": ("px", "number", None), "n": ("n", "integer", None)}, key=("symbol", "date"))
    rows, issues = intake.normalize(raw, contract)
    assert rows.count() == 3
    found = Counter((r.column, r.rule) for r in issues.collect())
    assert found == Counter({("price", "type"): 1, ("n", "type"): 1, ("date", "type"): 1, ("date", "missing_key"): 1, ("symbol", "duplicate_key"): 2} | ({("symbol", "missing_key"): 1} if raw.where("sym is null").count() else {}))
    assert intake.aggregate_issues(issues).where("rule = 'duplicate_key'").first().rows == 2
    with pytest.raises(ValidationError):
        intake.read_admitted(rows, issues, purpose="daily_bars", symbols=["A"])
    assert intake.read_admitted(rows, issues, purpose="exploration", symbols=["A"]).count() == 2
    for text in ("a,a\n1,2\n", "a,\n1,2\n"):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(ValidationError):
            intake.read_delimited(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        intake.read_delimited(spark, str(tmp_path / "c.csv")).collect()
    with pytest.raises(ValidationError):
        intake.Contract({"d": ("d", "date", None)})


def test_sql_is_only_read(spark, tmp_path):
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/secret")
    view = SqlView({"event_trade": spark.range(5).withColumnRenamed("id", "n")})
    assert view.query("select sum(n) as s from event_trade where n > ?", [1]).first().s == 9
    assert view.query("with t as (select n from event_trade) select count(*) as c from t where 'drop table x' <> ''").first().c == 5
    for bad in ("drop table event_trade", "create table x as select 1", "insert into event_trade select 1", "set a=b", "cache table event_trade", f"select * from parquet.`{tmp_path}/secret`", "select * from other", "select (select count(*) from other)", "show tables", "describe event_trade"):
        with pytest.raises(Exception):  # noqa: B017
            view.query(bad).collect()


def test_exchange_messages(spark):
    messages = [
        {"e": "trade", "E": 1000, "T": 900, "s": "AB", "t": 7, "p": "10.5", "q": "2", "m": True},
        {"e": "bookTicker", "E": 1000, "s": "AB", "u": 8, "b": "10.4", "B": "1", "a": "10.6", "A": "3"},
        {"e": "depthSnapshot", "E": 1000, "s": "AB", "lastUpdateId": 5, "bids": [["10.4", "1"]], "asks": [["10.6", "2"]]},
        {"e": "depthUpdate", "E": 1100, "s": "AB", "U": 6, "u": 9, "b": [["10.4", "0"], ["10.3", "1"]], "a": [["10.7", "4"]]},
        {"e": "markPriceUpdate", "E": 1200, "s": "AB", "p": "10.55"},
        {"e": "other"},
    ]
    df = spark.createDataFrame([(json.dumps(m),) for m in messages], "value string")
    got = exchange.diff_depth_events(df, price_scale=2, quantity_scale=0).orderBy("sequence").collect()
    kinds = Counter(r.event_type for r in got)
    assert kinds == Counter({"book_delta": 3, "trade": 1, "quote": 1, "book_snapshot": 1, "mark_price": 1})
    deltas = [r for r in got if r.event_type == "book_delta"]
    assert [(r.side, r.action, r.price.units, r.previous_sequence) for r in deltas] == [("bid", "delete", 1040, None), ("bid", "upsert", 1030, 9_000_001), ("ask", "upsert", 1070, 9_000_002)]
    assert next(r for r in got if r.event_type == "trade").aggressor_side == "sell"
    channel = [{"arg": {"channel": "trades", "instId": "X"}, "data": [{"ts": "1000", "tradeId": "3", "px": "1.5", "sz": "2", "side": "buy"}]}, {"arg": {"channel": "books", "instId": "X"}, "action": "update", "data": [{"ts": "1000", "seqId": 4, "prevSeqId": 4, "bids": [], "asks": []}, {"ts": "1000", "seqId": 6, "prevSeqId": 4, "bids": [["1.4", "2", "0", "1"]], "asks": []}]}]
    got = exchange.channel_events(spark.createDataFrame([(json.dumps(m),) for m in channel], "value string"), price_scale=1, quantity_scale=0).collect()
    assert Counter(r.event_type for r in got) == Counter({"trade": 1, "book_delta": 1})
    pairs = spark.createDataFrame([([["3366.1", "7"], ["3366", "6"]], [["3366.8", "9"]])], "b array<array<string>>, a array<array<string>>")
    crc = binascii.crc32(b"3366.1:7:3366.8:9:3366:6")
    assert pairs.select(exchange.book_checksum(F.col("b"), F.col("a"))).first()[0] == (crc - 2**32 if crc >= 2**31 else crc)


def test_provider_ids_are_chained(spark):
    frame = lambda messages: spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(messages)], "ingest_ordinal long, value string")
    snap = lambda n: {"e": "depthSnapshot", "E": 1000, "s": "AB", "lastUpdateId": n, "bids": [["10", "1"]], "asks": [["12", "2"]]}
    step = lambda pu, u, b=(("9", "1"),): {"e": "depthUpdate", "E": 1000, "s": "AB", "U": pu + 1, "u": u, "pu": pu, "b": list(b), "a": []}
    f = exchange.FACTOR

    def found(messages):
        df = frame(messages)
        deltas = [r for r in exchange.diff_depth_events(df, price_scale=0, quantity_scale=0).collect() if r.event_type == "book_delta"]
        return sorted((r.update, r.fault) for r in exchange.diff_depth_faults(df).collect()), {r.sequence - r.sequence // f * f + r.sequence // f * 10: r.previous_sequence for r in deltas}

    whole = [snap(5), step(5, 7, (("9", "1"), ("8", "1"))), step(7, 9, ()), step(9, 11), snap(20), step(20, 21)]
    assert found(whole) == ([], {71: 5 * f, 72: 7 * f + 1, 111: 7 * f + 2, 211: 20 * f})
    assert found([snap(5), step(5, 7), step(9, 11)]) == ([(11, "gap")], {71: 5 * f, 111: None})  # 9 was lost
    assert found([snap(5), step(7, 9), step(5, 7)])[0] == [(7, "gap"), (9, "gap")]  # reversed
    assert found([step(4, 5), snap(5), step(5, 7), step(5, 7)])[0] == [(5, "no_snapshot"), (7, "gap")]
    assert found([snap(5), snap(4)])[0] == [(4, "snapshot_not_advancing")]
    assert found([snap(5), {**step(5, 7), "U": 7}])[0] == [(7, "range")]

    def channel(*rows):
        ms = [{"arg": {"channel": "books", "instId": "X"}, "action": a, "data": [{"ts": "1000", "seqId": q, "prevSeqId": p, "bids": [["1", "2"]] if n else [], "asks": []}]} for a, p, q, n in rows]
        df = frame(ms)
        return sorted((r.update, r.fault) for r in exchange.channel_faults(df).collect()), sorted((r.sequence, r.previous_sequence) for r in exchange.channel_events(df, price_scale=0, quantity_scale=0).where("event_type = 'book_delta'").collect())

    s, u = "snapshot", "update"
    assert channel((s, -1, 4, 1), (u, 4, 4, 0), (u, 4, 5, 0), (u, 5, 6, 1)) == ([], [(6 * f + 1, 4 * f)])  # a heartbeat, an update without levels
    assert channel((s, -1, 4, 1), (u, 5, 5, 0), (u, 5, 6, 1))[0] == [(5, "gap")]
    assert channel((s, -1, 9, 1), (u, 9, 3, 0), (u, 3, 4, 1), (s, -1, 5, 1), (u, 5, 6, 1)) == ([(3, "reset"), (4, "no_snapshot")], [(4 * f + 1, None), (6 * f + 1, 5 * f)])


def test_feed_synchronisation_as_a_stream(spark, tmp_path):
    frames = [("f", 1, 1, 3, None), ("f", 2, None, 5, None), ("f", 3, 1, 4, None), ("f", 4, 4, 7, None), ("f", 5, 8, 9, None), ("f", 6, 8, 9, None), ("f", 7, 12, 13, None), ("f", 8, 14, 15, None), ("f", 9, None, 20, None), ("f", 10, 21, 22, None)]
    df = spark.createDataFrame(frames, "stream string, ordinal long, first_id long, last_id long, previous_id long")
    for n, part in enumerate((df.where("ordinal <= 4"), df.where("ordinal > 4"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = capture.synchronised(stream).writeStream.outputMode("append").foreachBatch(capture.publish_each_batch_once(f"file://{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    out = capture.published(spark, f"file://{tmp_path}/out", "stream string, first_id long, last_id long, outcome string, state string")
    assert Counter(r.outcome for r in out.collect()) == Counter(["buffered", "snapshot", "late", "bridge", "live", "duplicate", "gap", "buffered", "snapshot", "bridge"])


def test_buffered_frames_are_let_in_after_the_snapshot(spark, tmp_path):
    # 4 to 7 bridges snapshot 5 and came before it; the snapshot comes in another batch
    frames = [("f", 1, 1, 3, None), ("f", 2, 4, 7, None), ("f", 3, 8, 9, None), ("f", 4, None, 5, None), ("f", 5, 10, 11, None)]
    frames += [("r", 1, None, 50, None), ("r", 2, 51, 52, 50), ("r", 3, 3, 3, 52), ("r", 4, 4, 4, 3), ("r", 5, None, 3, None), ("r", 6, 5, 5, 4)]
    df = spark.createDataFrame(frames, "stream string, ordinal long, first_id long, last_id long, previous_id long")
    for part in (df.where("ordinal <= 3"), df.where("ordinal > 3")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = capture.synchronised(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), chained=True).writeStream.outputMode("append").foreachBatch(capture.publish_each_batch_once(f"file://{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    out = capture.published(spark, f"file://{tmp_path}/out", "stream string, first_id long, last_id long, outcome string, state string").collect()
    of = lambda s: Counter((r.last_id, r.outcome) for r in out if r.stream == s)
    assert of("f") == Counter([(3, "buffered"), (7, "buffered"), (9, "buffered"), (5, "snapshot"), (7, "bridge"), (9, "live"), (11, "live")])
    assert of("r") == Counter([(50, "snapshot"), (52, "bridge"), (3, "reset"), (4, "buffered"), (3, "snapshot"), (4, "bridge"), (5, "live")])


def test_how_the_first_update_meets_its_snapshot():
    def outcomes(frames, **kw):
        feed = capture.FeedSync(**kw)
        return [feed.admit(*f) for f in frames], feed.state

    snapshot = (None, 20, None)
    assert outcomes([snapshot, (21, 22, None)]) == (["snapshot", "bridge"], "LIVE")
    assert outcomes([snapshot, (21, 22, None)], overlap=True) == (["snapshot", "gap"], "RESYNC")
    assert outcomes([snapshot, (19, 20, None), (20, 22, None)], overlap=True) == (["snapshot", "late", "bridge"], "LIVE")
    assert outcomes([snapshot, (23, 21, None)]) == (["snapshot", "gap"], "RESYNC")
    assert outcomes([snapshot, (22, 23, None)])[0] == ["snapshot", "gap"]


def test_bars_over_a_stream_equal_bars_at_once(spark, tmp_path):
    rnd = random.Random(8)
    data = [("s", rnd.choice("ab"), T0 + timedelta(minutes=rnd.randint(0, 200)), i, str(i), rnd.randint(1, 9), 1) for i in range(300)] + [("s", "z", T0 + timedelta(days=2), 999, "999", 1, 1)]
    df = spark.createDataFrame(data, "source string, instrument_id string, event_time timestamp, sequence long, event_id string, price long, quantity long")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = capture.streaming_bars(stream).writeStream.format("memory").queryName("bars_out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    pick = ["instrument_id", "bar_start", "open", "close", "volume"]
    whole = capture.streaming_bars(df).where("instrument_id <> 'z'").select(*pick)
    assert Counter(map(tuple, spark.table("bars_out").select(*pick).collect())) == Counter(map(tuple, whole.collect()))


def test_receipts_increase(spark):
    df = spark.createDataFrame([("s", i, T0 + timedelta(microseconds=t)) for i, t in enumerate([5, 5, 3, 20, 20])], "k string, o long, r timestamp")
    got = [r.r.microsecond for r in capture.increasing_receipts(df, "k", "r", "o").orderBy("o").collect()]
    assert got == [5, 6, 7, 20, 21]
