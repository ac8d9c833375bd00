"""The general data problems against brute force on small rows: nulls, ties, repeats, empty tables, clashing columns."""

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.differential import PeriodLog, counted_rows, period_deltas, present_state, restated_periods
from tidemark.operators.dyadic import FOREVER, as_known, disjoint, stab
from tidemark.operators.equality_deletes import EqualityDeleteTable, books_at_end
from tidemark.operators.history import attribute_history
from tidemark.operators.skew import dense_aggregate, heavy_keys
from tidemark.streaming.delivery import DeliveryLog, repeated_deliveries

T0 = datetime(2024, 3, 4, 10, tzinfo=UTC)
FP = "struct<units: bigint, scale: smallint>"


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# 1


def test_dense_aggregate_equals_plain_grouping(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 20 + ["a", "b", None, ""]), rnd.choice([None, rnd.randint(-(2**40), 2**62)]), i, i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v long, _block long, rows long").repartition(5)
    measures = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("sum", "rows")}
    want = df.where("k is not null").groupBy("k").agg(F.count("*").alias("c"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.min("v"), F.max("v"), F.sum(F.col("rows").cast("decimal(38,0)")))
    for size in (1 << 25, 0):  # one dictionary, and one for each batch
        assert rows(dense_aggregate(df, ["k"], measures, block=2, broadcast_bytes=size)) == rows(want)


def test_first_and_last_of_keys(spark):
    rnd = random.Random(12)
    data = [(rnd.choice([*"abc", *map(str, range(30))]), rnd.choice([None, *range(-9, 9)]), rnd.choice([None, *range(4)]), i) for i in range(3000)]
    data += [("nulls", None, 1, 3000)]
    df = spark.createDataFrame(data, "k string, v long, t long, i long").repartition(5)
    want = {}
    for k, v, t, i in data:
        want.setdefault(k, [])
        if v is not None:
            want[k].append(((-1 if t is None else t, i), v))
    want = Counter((k, min(x)[1] if x else None, max(x)[1] if x else None) for k, x in want.items())
    for size in (0, 1 << 20):
        out = dense_aggregate(df, ["k"], {"first": ("first", "v", ["t", "i"]), "n": ("sum", "v"), "last": ("last", "v", ["t", "i"])}, block=2, broadcast_bytes=size)
        assert rows(out.select("k", "first", "last")) == want


def test_keys_beyond_one_dictionary(spark):
    """Two key columns, one key with half of all rows, more keys than a batch has rows; no row of a key is moved before it is added up."""
    df = spark.range(0, 200_000, 1, 6).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 60_001).cast("string"))).alias("_k1"), (F.col("id") % 3).cast("int").alias("b"), F.col("id").alias("v"))
    got = dense_aggregate(df, ["_k1", "b"], {"s": ("sum", "v"), "last": ("last", "v", ["v"])}, broadcast_bytes=0)
    want = df.groupBy("_k1", "b").agg(F.count("*").alias("rows"), F.sum("v").cast("decimal(38,0)").alias("s"), F.max("v").alias("last"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_dense_aggregate_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert dense_aggregate(df, ["k"], {"s": ("sum", "v")}).collect() == []
    assert heavy_keys(df, "k", "k").collect() == []


def test_heavy_keys_count_nulls_in_the_total(spark):
    data = [("t", "x")] * 4 + [("t", None)] * 6 + [("u", "x")] + [("t", f"k{i}") for i in range(90)]
    df = spark.createDataFrame(data, "g string, k string")
    assert rows(heavy_keys(df, "g", "k", 0.03)) == Counter([("t", "x"), ("u", "x")])
    assert rows(heavy_keys(df, "g", "k", 0.04)) == Counter([("u", "x")])  # more than, not as many as


# 2


def brute_repeats(deliveries, sha):
    groups = defaultdict(list)
    for d, event_id, _, received in deliveries:
        key = (event_id or "").strip()
        if key and sha.get(d):
            groups[key, int(sha[d].strip(), 16)].append((received is None, received or T0, d))
    return {d for g in groups.values() for _, _, d in sorted(g)[1:]}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_deliveries_in_and_across_batches(spark, seed):
    rnd = random.Random(seed)
    deliveries, sha = [], {}
    for d in range(400):
        message = rnd.choice([0] * 3 + list(range(60)))
        event = message * 20
        spelled = rnd.choice([f"id-{message}", f" id-{message}\n", f"\tid-{message}"]) if message % 7 else rnd.choice([None, " ", ""])
        deliveries.append((d, spelled, at(event), rnd.choice([None, *[at(event + rnd.randint(0, 4000))] * 5])))
        number = f"{message // 2 + 10:x}"
        sha[d] = rnd.choice([number.zfill(64), number.upper(), "0x" + number]) if d % 50 else None
    df = spark.createDataFrame(deliveries, "delivery_id long, event_id string, event_time timestamp, received_at timestamp").withColumn("k1", F.lit(1)).withColumn("epoch", F.lit("x"))
    claims = spark.createDataFrame([(d, s, "a") for d, s in sha.items()] * 2, "delivery_id long, event_sha256 string, event_id string")
    got = rows(repeated_deliveries(df, claims, lateness="30 minutes", buckets=3))
    assert got == Counter((d,) for d in brute_repeats(deliveries, sha))


def test_repeated_deliveries_of_nothing(spark):
    d = spark.createDataFrame([], "delivery_id long, event_id string, event_time timestamp, received_at timestamp")
    c = spark.createDataFrame([], "delivery_id long, event_sha256 string")
    assert repeated_deliveries(d, c).collect() == []
    one = spark.createDataFrame([(1, "a", None, None), (2, "a", None, None), (3, "a", None, None)], d.schema)
    assert repeated_deliveries(one, c).collect() == []
    two = spark.createDataFrame([(1, "aa"), (2, "AA"), (3, None)], c.schema)
    assert rows(repeated_deliveries(one, two)) == Counter([(2,)])


@pytest.mark.parametrize("lateness", ["1 minute", "1 day", "900 days"])
def test_lateness_epochs_and_order_of_calls_change_no_result(spark, lateness):
    """Copies of one message with event times that are null or far apart, one row a batch of Arrow, in one call or several."""
    rnd = random.Random(8)
    deliveries, sha = [], {}
    for d in range(150):
        message = rnd.randint(0, 40)
        deliveries.append((d, f"m{message}", rnd.choice([None, *[at(rnd.randint(0, 60000))] * 6]), rnd.choice([None, *[at(rnd.randint(0, 60000))] * 6])))
        sha[d] = f"{message % 3 + 1:x}"
    deliveries += deliveries[:9]  # rows of the table twice are one delivery
    schema = "delivery_id long, event_id string, event_time timestamp, received_at timestamp"
    df = spark.createDataFrame(deliveries, schema)
    claims = spark.createDataFrame(list(sha.items()), "delivery_id long, event_sha256 string")
    want = Counter((d,) for d in brute_repeats(list(dict.fromkeys(deliveries)), sha))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert rows(repeated_deliveries(df, claims, lateness=lateness, epochs=6, buckets=1)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    log = DeliveryLog(spark, lateness=lateness, buckets=2)
    for part in (2, 0, 1):  # later deliveries may have come in earlier
        log = DeliveryLog(spark, log.path, lateness=lateness, buckets=2)
        log.append(df.where(F.col("delivery_id") % 3 == part), claims, epochs=2)
    assert rows(log.removed()) == want
    log.append(df.limit(0), claims)
    assert rows(log.removed()) == want
    assert DeliveryLog(spark, log.path, lateness="3 hours").lateness == lateness  # the one it began with


# 3

DELTA = f"instrument_id string, source string, session_id string, sequence long, side string, action string, price {FP}, quantity {FP}, event_id string"
SNAPSHOT = f"instrument_id string, source string, session_id string, sequence long, bids array<struct<price: {FP}, quantity: {FP}, order_count: bigint>>, asks array<struct<price: {FP}, quantity: {FP}, order_count: bigint>>"


def test_books_whatever_order_and_repetition(spark):
    rnd = random.Random(3)
    book = ("i", "s", None)
    deltas, content = [], {}
    for seq in range(1, 60):
        side, price, quantity, action = rnd.choice("ab"), rnd.randint(1, 5), rnd.choice([0, 3, 40]), rnd.choice(["delete", "upsert", None])
        content[seq] = ("bid" if side == "b" else "ask", price, quantity, action)
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randint(0, 3)
            deltas.append((*book, seq, rnd.choice([" BID", "bid"]) if side == "b" else rnd.choice(["Ask ", "ask"]), action and rnd.choice([action, action.upper() + " "]), (price * 10**k, k), (quantity * 10**k, k), f"e{rnd.random()}"))
    rnd.shuffle(deltas)
    level = lambda p, q: ((p, 0), (q, 0), None)
    snapshots = [(*book, 10, [level(1, 7)], [level(2, 7)]), (*book, 30, [level(3, 9), level(4, 0)], None), (*book, 30, [level(3, 9), level(4, 0)], None), ("j", "s", "x", 5, [level(8, 1)], [])]
    want = {("bid", 3): 9}
    for seq, (side, price, quantity, action) in sorted(content.items()):
        if seq > 30:
            want.pop((side, price), None)
            if action != "delete" and quantity:
                want[side, price] = quantity
    expected = Counter([(*book, s, p * 10**8, q * 10**8) for (s, p), q in want.items()] + [("j", "s", "x", "bid", 8 * 10**8, 10**8)])
    d, s = spark.createDataFrame(deltas, DELTA), spark.createDataFrame(snapshots, SNAPSHOT)
    assert rows(books_at_end(d, s)) == expected
    table = EqualityDeleteTable(spark)  # in parts, in any order of appends
    table.append_changes(d.where("sequence % 2 = 0"))
    table.append_snapshots(s)
    table.append_changes(d.where("sequence % 2 = 1"))
    table.append_changes(d)
    assert rows(table.read()) == expected
    table.compact()
    assert rows(table.read()) == expected and len(table._commits()) == 1
    table.append_changes(d.where("sequence % 3 = 0"))  # come again, too late
    assert rows(table.read()) == expected


def test_books_without_rows_or_levels(spark):
    d, s = spark.createDataFrame([], DELTA), spark.createDataFrame([], SNAPSHOT)
    assert books_at_end(d, s).collect() == []
    odd = spark.createDataFrame([("i", "s", "x", 1, None, "upsert", (1, 0), (1, 0), "e"), ("i", "s", "x", 2, "bid", "upsert", None, (1, 0), "e"), ("i", "s", "x", 3, "bid", "upsert", (1, 0), None, "e")], DELTA)
    assert books_at_end(odd, s).collect() == []


# 4


def test_stab_equals_comparison(spark):
    rnd = random.Random(4)
    big = 1 << 40
    spans = [(rnd.choice("ab"), a, rnd.choice([a, a + 1, a + rnd.randint(1, big), FOREVER]), i) for i in range(60) if (a := rnd.randint(-big, big)) or True]
    points = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randint(-big, 2 * big), rnd.choice(spans)[1], rnd.choice(spans)[2] - 1]), i) for i in range(80)] + [("a", None, 99)]
    points = [(k, t if t is None or t < FOREVER - 1 else big, i) for k, t, i in points]
    want = Counter((p, s) for k, t, p in points for key, a, b, s in spans if k == key and t is not None and a <= t < b)
    left = spark.createDataFrame(points, "k string, t long, p long")
    right = spark.createDataFrame(spans, "k string, start long, end long, s long")
    for limit in (10**6, 0):
        assert rows(stab(left, right, "k", "t", broadcast_rows=limit).select("p", "s")) == want
    cut = disjoint(right, "k", ["s"])
    best = {}
    for p, s in want:
        best[p] = max(best.get(p, -1), s)
    assert rows(stab(left, cut, "k", "t").select("p", "s")) == Counter(best.items())


def test_as_known_uses_nothing_that_became_known_later(spark):
    catalog = [
        (1, "A", at(0), None, at(0), "EUR"),
        (2, "A", at(0), at(100), at(50), "EUR"),  # replaces 1 from minute 50, and ends
        (3, "A", at(60), None, at(70), "USD"),
        (4, "A", at(60), None, at(70), "GBP"),  # equal to 3: the smaller id counts
        (5, "B", at(0), at(0), at(0), "EUR"),
        (6, None, at(0), None, at(0), "EUR"),
        (7, "C", at(0), None, at(0), None),
    ]
    iso = lambda m: at(m).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    rates = [("r1", "EUR", "USD", iso(1), iso(5)), ("r2", "EUR", "USD", iso(2), iso(30)), ("r3", "EUR", "USD", iso(1), iso(40)), ("r4", "USD", "EUR", iso(1), iso(1)), ("r5", "EUR", "USD", "2024-03-04T12:00:00+02:00", None), ("r6", "EUR", "USD", "bad", iso(1))]
    events = [(1, "x:y:A", at(0)), (2, "x:y:A", at(5)), (3, "x:y:A", at(45)), (4, "x:y:A", at(65)), (5, "x:y:A", at(70)), (6, "x:y:A", at(-1)), (7, "x:y:B", at(1)), (8, None, at(1)), (9, "x:y:A", None), (10, "x:y:C", at(3)), (11, "odd", at(3)), (5, "x:y:A", at(70))]
    df = spark.createDataFrame(events, "delivery_id long, instrument_id string, event_time timestamp").withColumn("start", F.lit(1)).withColumn("symbol2", F.lit(1))
    c = spark.createDataFrame(catalog, "catalog_row_id long, symbol string, effective_from timestamp, effective_to timestamp, available_at timestamp, settlement_currency string")
    f = spark.createDataFrame(rates, "event_id string, base_currency string, quote_currency string, observed_at string, available_at string")
    want = Counter([(1, 1, ""), (2, 1, "r1"), (3, 1, "r2"), (4, 2, "r2"), (5, 3, ""), (5, 3, ""), (10, 7, "")])
    assert rows(as_known(df, c, f)) == want
    assert as_known(df, c.limit(0), f).collect() == []
    assert rows(as_known(df, c, f.limit(0))) == Counter([(i, c, "") for i, c, _ in want.elements()])


# 5

RECORD = "record_id long, record_kind string, symbol string, venue string, price_tick string, lot_size int, commission_rate string, stamp_duty_rate string, price_limit_rate string, effective_from timestamp, available_at timestamp"


def us(minutes):
    return int(at(minutes).timestamp() * 10**6)


def test_history_of_attributes(spark):
    def r(i, kind, symbol, start, tick, known=0, venue="V"):
        return (i, kind, symbol, venue, tick, 1, None, "", "0.1", at(start), at(known))

    data = [
        r(1, "snapshot", "a", 0, "0.1"), r(2, "snapshot", " A", 10, "1E-1", venue="v "), r(3, "snapshot", "A", 20, "0.2"),
        r(4, "update", "A", 15, "0.10"), r(5, "snapshot", "A", 40, "0.2"), r(6, "update", "A", 45, "0.3"), r(7, "update", "A", 45, "0.4", known=1),
        r(8, "snapshot", "B", 0, "0.1"), r(9, "snapshot", None, 30, "0.1"), r(10, "snapshot", " ", 50, "0.1"), r(4, "update", "A", 15, "0.10"),
        r(11, "update", "C", 100, "x"),
    ]
    got = rows(attribute_history(spark.createDataFrame(data, RECORD)).select("symbol", "effective_from_us", "effective_to_us"))
    # A: 0.1 from 0 to 20; 0.2 from 20 until the snapshot at 30 misses it; again at 40; 0.4 from 45 to the snapshot at 50
    want = [("A", us(0), us(20)), ("A", us(20), us(30)), ("A", us(40), us(45)), ("A", us(45), us(50)), ("B", us(0), us(10)), ("C", us(100), 0)]
    assert got == Counter(want)
    assert attribute_history(spark.createDataFrame([], RECORD)).collect() == []


def test_history_over_many_words(spark):
    data = [(i, "update", "A", "V", str(i // 100), 1, None, None, None, at(i), at(i)) for i in range(450)]
    got = rows(attribute_history(spark.createDataFrame(data, RECORD)).select("effective_from_us", "effective_to_us"))
    assert got == Counter((us(100 * k), us(100 * k + 100) if k < 4 else 0) for k in range(5))


# 6

TRADE = f"delivery_id long, instrument_id string, session_id string, event_time timestamp, available_at timestamp, sequence long, quantity {FP}"


def test_restated_periods(spark):
    rnd = random.Random(6)
    data = [(i, rnd.choice(["a", "b", None]), rnd.choice(["s", None]), at(e := rnd.randint(0, 90)), rnd.choice([None, *[at(e + rnd.choice([0, 1, 32, 60, 200, 389, 391, 500]))] * 9]), rnd.randint(1, 40), (rnd.randint(1, 9), 1)) for i in range(300)]
    periods = defaultdict(list)
    for _, i, s, e, a, q, f in data:
        start = (e - T0) // timedelta(minutes=30) * 30
        if i and a and a <= at(start + 30 + 360):
            periods[i, s, us(start)].append((a > at(start + 31), e, q, f[0] * 10**7))
    want = Counter((*k, max((e, q) for _, e, q, _ in v)[1]) for k, v in periods.items() if any(late for late, *_ in v))
    df = spark.createDataFrame(data, TRADE).withColumn("version", F.lit("x"))
    assert rows(restated_periods(df)) == want
    deltas = period_deltas(counted_rows(df, tick=30 * 60 * 10**6))
    state = {tuple(r[:3]): (r["trades"], int(r["volume_e8"])) for r in present_state(deltas).collect()}
    assert state == {k: (len(v), sum(x[3] for x in v)) for k, v in periods.items()}
    signs = Counter(r["sign"] for r in deltas.collect())
    assert signs[1] - signs[-1] == len(periods)
    assert restated_periods(df.limit(0)).collect() == []


def test_restated_periods_batch_by_batch(spark):
    """Rows of each tick taken up by a call of its own, null sequences and periods among them, and a state that was compacted."""
    rnd = random.Random(16)
    data = [(i, rnd.choice("ab"), rnd.choice(["s", None]), at(e := rnd.randint(0, 60)), at(e + rnd.choice([0, 40, 90, 150, 300])), rnd.choice([None, *range(5)]), (rnd.randint(1, 9), 1)) for i in range(200)]
    counted = counted_rows(spark.createDataFrame(data, TRADE))
    whole = period_deltas(counted)
    assert min(r["close_sequence"] is not None and r["close_sequence"] for r in whole.collect()) >= 0
    log = PeriodLog(spark)
    for v in range(7):
        PeriodLog(spark, log.path).take(counted.where(F.col("version") == v))
    columns = [c for c in whole.columns if c != "close_sequence"]
    assert rows(log.deltas().select(columns)) == rows(whole.select(columns))
    before = rows(present_state(log.deltas()))
    log.compact()
    assert rows(present_state(log.deltas())) == before and log.deltas().where("sign < 0").isEmpty()
    again = {k: v for k, v in ((tuple(r)[:3], r) for r in present_state(log.deltas()).collect())}
    log.take(counted.where("version = 3"))  # other rows of these periods
    for r in present_state(log.deltas()).collect():
        assert r["trades"] >= again[tuple(r)[:3]]["trades"]
