"""The point-in-time operators against brute force: ties, nulls, revisions, clashing columns, empty inputs."""

import random
from collections import Counter, defaultdict
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, checks, finance, graph, quality
from tidemark.operators.checks import ValidationError

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width", [60, 7 * 86400])
def test_backward_join(spark, width):
    rnd = random.Random(2)
    facts = list({(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 200, 5)])): rnd.choice([None, 1, 2]) for _ in range(60)}.items())
    facts = [(k, at(t), v) for (k, t), v in facts]
    seen = [(i, rnd.choice(["a", "b", "c", None]), at(rnd.choice([None, *range(0, 240, 5)]))) for i in range(80)]
    want = Counter()
    for i, k, t in seen:
        known = sorted((a, v is not None, v or 0, v) for q, a, v in facts if q == k and k and a and t and a <= t)
        want[i, *((known[-1][0].replace(tzinfo=None), known[-1][3]) if known else (None, None))] += 1
    o = spark.createDataFrame(seen, "i long, symbol string, date timestamp").withColumn("_at", F.lit("clash"))
    f = spark.createDataFrame(facts, "symbol string, available_at timestamp, value long")
    got = asof.point_in_time_join(o, f, slice_seconds=width)
    assert Counter((r.i, r.source_available_at, r.value) for r in got.collect()) == want
    assert asof.point_in_time_join(o.limit(0), f).columns == [*o.columns, "source_available_at", "value"]
    assert asof.point_in_time_join(o, f.limit(0)).where("value is not null").count() == 0


def test_conflicts_and_future_rows_raise(spark):
    f = spark.createDataFrame([("a", at(0), 1), ("a", at(0), 2)], "symbol string, available_at timestamp, value long")
    o = spark.createDataFrame([("a", at(5))], "symbol string, date timestamp")
    with pytest.raises(ValidationError):
        asof.point_in_time_join(o, f)
    assert asof.point_in_time_join(o, f.limit(1).unionByName(f.limit(1))).first().value == 1
    with pytest.raises(ValidationError):
        asof.refuse_future(o.withColumn("source_available_at", F.lit(at(9))))
    with pytest.raises(ValidationError):
        asof.point_in_time_join(o, f, columns=["none"])


def test_max_age_leaves_nulls_and_no_older_fact(spark):
    f = spark.createDataFrame([("a", at(0), 1), ("a", at(10), 2)], "symbol string, available_at timestamp, value long")
    o = spark.createDataFrame([("a", at(t)) for t in (10, 20, 21)], "symbol string, date timestamp")
    assert [r.value for r in asof.point_in_time_join(o, f, max_age="10 minutes").orderBy("date").collect()] == [2, 2, None]


def test_two_clocks(spark):
    rnd = random.Random(3)
    facts = [("a", at(rnd.randint(0, 50)), at(rnd.randint(0, 50)), i) for i in range(25)]
    seen = [(i, "a", at(rnd.randint(0, 60))) for i in range(40)]
    want = {i: max(((e, a, v) for _, e, a, v in facts if e <= t and a <= t), default=(None,) * 3)[2] for i, _, t in seen}
    got = asof.two_clock_join(spark.createDataFrame(seen, "i long, s string, t timestamp"), spark.createDataFrame(facts, "s string, effective_at timestamp, available_at timestamp, v long"), time="t", by=("s",), columns=["v"])
    assert {r.i: r.v for r in got.collect()} == want


def test_bitemporal(spark):
    rnd = random.Random(4)
    facts = []
    for i in range(40):
        f, a = rnd.randint(0, 100), rnd.randint(0, 100)
        facts.append((rnd.choice("ab"), at(f), at(rnd.choice([None, f + rnd.randint(1, 40)])), at(a), at(rnd.choice([None, a + rnd.randint(1, 40)])), i))
    df = spark.createDataFrame(facts, "instrument_id string, effective_from timestamp, effective_to timestamp, available_at timestamp, superseded_at timestamp, v long")
    late = at(10**6)
    over = lambda x, y: x[1] < (y[2] or late) and y[1] < (x[2] or late) and x[3] < (y[4] or late) and y[3] < (x[4] or late)
    known = sorted(facts, key=lambda x: (x[0], x[3], x[1], x[2] or late, x[4] or late))
    want = sum(any(x[0] == y[0] and over(x, y) for x in known[:i]) for i, y in enumerate(known))
    assert asof.bitemporal_conflicts(df, ["instrument_id"]).count() == want > 0
    with pytest.raises(ValidationError):
        asof.bitemporal_join(df.select("instrument_id", F.col("effective_from").alias("observation_time"), F.col("available_at").alias("as_of")), df)
    seen = [(k, at(t), at(u)) for k in "ab" for t in range(0, 100, 9) for u in range(0, 100, 9)]
    got = asof.bitemporal_join(spark.createDataFrame(seen, "instrument_id string, observation_time timestamp, as_of timestamp"), df, check=False)
    want = Counter()
    for k, t, u in seen:
        hits = [v for q, f, e, a, s, v in facts if q == k and f <= t < (e or late) and a <= u < (s or late)]
        want.update((k, t.replace(tzinfo=None), u.replace(tzinfo=None), v) for v in hits or [None])
    assert Counter((r.instrument_id, r.observation_time, r.as_of, r.v) for r in got.collect()) == want


def test_bitemporal_with_a_hot_key_copies_nulls_and_names(spark):
    """Brute force over facts of one busy key, a key of two columns with nulls, names of the operator's own columns."""
    rnd = random.Random(21)
    day = lambda n: T0 + timedelta(days=n)
    facts = [(rnd.choice(["hot"] * 9 + ["a", None]), rnd.choice(["x", None]), day(a := rnd.randint(0, 300)), rnd.choice([None, day(a + rnd.randint(0, 40))]), day(k := rnd.randint(0, 300)), rnd.choice([None, day(k + rnd.randint(0, 60))]), i) for i in range(120)]
    facts += facts[:5]
    schema = "start string, end string, effective_from timestamp, effective_to timestamp, available_at timestamp, superseded_at timestamp, node int"
    df = spark.createDataFrame(facts, schema)
    end = lambda t: t or datetime.max.replace(tzinfo=UTC)
    order = sorted(facts, key=lambda f: (f[4], f[2], end(f[3]), end(f[5])))
    want = Counter()
    for i, (k1, k2, f, t, a, s, _) in enumerate(order):
        live = lambda f, t, a, s: f < end(t) and a < end(s)
        if live(f, t, a, s) and any(x[:2] == (k1, k2) and live(*x[2:6]) and a < end(x[5]) and x[2] < end(t) and f < end(x[3]) for x in order[:i]):
            want[k1, k2, f, a] += 1
    got = asof.bitemporal_conflicts(df, ["start", "end"])
    assert Counter((r[0], r[1], r[2].astimezone(UTC), r[3].astimezone(UTC)) for r in got.collect()) == want
    seen = [(i, "hot", "x", day(rnd.randint(-5, 320)), day(rnd.randint(0, 400))) for i in range(40)] + [(40, None, "x", day(9), day(9)), (41, "hot", None, day(9), day(9)), (42, "hot", "x", None, day(9))]
    o = spark.createDataFrame(seen, "level int, start string, end string, observation_time timestamp, as_of timestamp")
    found = Counter((r["level"], r["node"]) for r in asof.bitemporal_join(o, df, by=("start", "end"), check=False).collect())
    expect = Counter()
    for n, k1, k2, t, known in seen:
        hits = [f[6] for f in facts if None not in (k1, k2, t) and f[:2] == (k1, k2) and f[2] <= t < end(f[3]) and f[4] <= known < end(f[5])]
        expect.update((n, h) for h in hits or [None])
    assert found == expect
    one = spark.createDataFrame(facts[:1], schema)
    there = spark.createDataFrame([(1, facts[0][0], "x", facts[0][2], facts[0][4])], o.schema)
    if facts[0][3] and facts[0][3] > facts[0][2]:
        assert asof.resolve_mapping(there.withColumn("end", F.lit(facts[0][1])), one, by=("start",), columns=["node"]).count() == 1
    with pytest.raises(ValidationError):
        asof.resolve_mapping(o, one, by=("start",), columns=["node"])


def _trades(n, seed=5):
    rnd = random.Random(seed)
    return [("s", rnd.choice("ab"), date(2024, 1, 1), "x", at(rnd.randint(0, 300)), i, f"{i:04d}", rnd.randint(1, 50), rnd.randint(1, 9), at(400), at(401)) for i in range(n)]


TRADE = "source string, instrument_id string, trading_day date, session_id string, event_time timestamp, sequence long, event_id string, price long, quantity long, received_at timestamp, available_at timestamp"


def test_bars_of_each_kind(spark):
    data = _trades(400)
    df = spark.createDataFrame(data, TRADE)
    starts = spark.createDataFrame([("x", at(5), at(301), "v", date(2024, 1, 1))], "session_id string, opens_at timestamp, closes_at timestamp, venue string, trading_day date")
    streams = defaultdict(list)
    for t in sorted(data, key=lambda t: (t[1], t[4], t[5], t[6])):
        streams[t[1]].append(t)
    ohlc = lambda g: (g[0][7], max(t[7] for t in g), min(t[7] for t in g), g[-1][7], sum(t[8] for t in g), len(g))
    want = Counter()
    for k, ts in streams.items():
        slots = defaultdict(list)
        for t in ts:
            if t[4] >= at(5):
                slots[(t[4] - at(5)) // timedelta(minutes=60)].append(t)
        want.update((k, *ohlc(g)) for g in slots.values())
    pick = lambda b: Counter((r.instrument_id, r.open, r.high, r.low, r.close, r.volume, r.trades) for r in b.collect())
    assert pick(bars.interval_bars(df, starts, 3600 * 10**6)) == want
    assert bars.untimely_trades(df, starts).count() == sum(t[4] < at(5) for t in data)
    whole = Counter((k, *ohlc(ts)) for k, ts in streams.items())
    assert pick(bars.session_bars(df, starts)) == whole
    assert pick(bars.day_bars(df, starts, spark.createDataFrame([("a", "v"), ("b", "v")], "instrument_id string, venue string"))) == whole
    assert pick(bars.count_bars(df, 30)) == Counter((k, *ohlc(ts[i : i + 30])) for k, ts in streams.items() for i in range(0, len(ts) - 29, 30))
    want = Counter()
    for k, ts in streams.items():
        held, group = 0, []
        for t in ts:
            held, group = held + t[8], [*group, t]
            if held >= 40:
                want[k, *ohlc(group)] += 1
                held, group = 0, []
    assert pick(bars.amount_bars(df, F.col("quantity"), 40)) == want
    assert bars.amount_bars(df.limit(0), F.col("quantity"), 40).collect() == []


def test_returns_labels_and_adjustment(spark):
    days = [date(2024, 1, d) for d in range(1, 11)]
    rnd = random.Random(6)
    close = {d: rnd.randint(50, 100) * 1.0 for d in days}
    prices = spark.createDataFrame([("a", d, c) for d, c in close.items()], "symbol string, date date, close double")
    acts = spark.createDataFrame([("a", days[4], 2.0, None), ("a", days[6], None, 5.0)], "symbol string, date date, ratio double, cash double")
    index, want = 100.0, {}
    for i, d in enumerate(days):
        if i:
            index *= (close[d] * (2.0 if i == 4 else 1.0) + (5.0 if i == 6 else 0.0)) / close[days[i - 1]]
        want[d] = index
    got = {r.date: r.return_close for r in finance.total_return(prices, acts).collect()}
    assert all(abs(got[d] - want[d]) < 1e-9 for d in days)
    with pytest.raises(ValidationError):
        finance.total_return(prices.where(F.col("date") != days[4]), acts)
    splits = spark.createDataFrame([("a", days[4], 1.0, 2.0), ("a", days[8], 3.0, 1.0)], "symbol string, ex_date date, cash_per_share double, share_ratio double")
    adjusted = {r.date: r.close for r in finance.adjust_prices(prices.select("symbol", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")]), splits).collect()}
    f1, f2 = (close[days[3]] - 1) / (close[days[3]] * 2), (close[days[7]] - 3) / close[days[7]]
    for i, d in enumerate(days):
        assert abs(adjusted[d] - close[d] * (f1 if i < 4 else 1) * (f2 if i < 8 else 1)) < 1e-9
    levels = prices.where(F.col("date") != days[5]).select(F.col("symbol").alias("instrument_id"), "date", F.col("close").alias("value"), F.col("date").cast("timestamp").alias("available_at"))
    picks = spark.createDataFrame([(f"s{i}", "a", d, "suspended") for i, d in enumerate(days)], "sample_id string, instrument_id string, date date, missing_reason string")
    ends = spark.createDataFrame([("s8", days[9], -0.5, at(0), "x")], "sample_id string, date date, realized_return double, available_at timestamp, source string")
    labels = finance.forward_labels(levels, picks, prices.select("date"), horizon=2, as_of=F.lit("2024-01-20").cast("timestamp"), terminals=ends, lower=-1.0, upper=1.0)
    status = {r.sample_id: (r.status, r["return"]) for r in labels.collect()}
    assert status["s0"] == ("observed", close[days[2]] / close[days[0]] - 1)
    assert [status[f"s{i}"][0] for i in range(10)] == ["observed"] * 3 + ["suspended"] * 3 + ["observed"] * 2 + ["terminal", "immature"]


def test_quarters_and_trailing_year(spark):
    q = lambda s, e, v, acc, kind="NetIncomeLoss": ("c", kind, "USD", s, e, v, at(60 * 24 * 500), acc)
    d = date
    facts = [q(d(2023, 1, 1), d(2023, 3, 31), 10.0, "a"), q(d(2023, 1, 1), d(2023, 6, 30), 30.0, "a"), q(d(2023, 7, 1), d(2023, 9, 30), 5.0, "a"), q(d(2023, 1, 1), d(2023, 9, 30), 35.0, "a"), q(d(2023, 1, 1), d(2023, 12, 31), 60.0, "a")]
    facts += [q(*x[3:5], x[5] / 2, "a", finance.CASH) for x in facts] + [("c", finance.ASSETS, "USD", None, d(2023, 12, 31), 100.0, at(60 * 24 * 500), "b")]
    df = spark.createDataFrame(facts, "instrument_id string, concept string, unit string, period_start date, period_end date, value double, available_at timestamp, accession string")
    when = F.lit("2025-07-01").cast("timestamp")
    quarters = finance.quarterly_facts(df.where(F.col("concept") == finance.INCOME), when).orderBy("period_end").collect()
    assert [(r.value, r.method) for r in quarters] == [(10.0, "reported_quarter"), (20.0, "cumulative_difference"), (5.0, "reported_quarter"), (25.0, "cumulative_difference")]
    assert finance.ttm_facts(df, when, max_age_days=600).orderBy("concept").collect()[1].value == 60.0
    assert finance.ttm_facts(df, when).collect() == []
    assert finance.annual_quality(df, when, max_age_days=600).first().roa_annual == 0.6
    with pytest.raises(ValidationError):
        asof.facts_asof(df.unionByName(df.limit(1).withColumn("value", F.lit(1.5))), when)


def test_look_through_conserves_weight(spark):
    h = lambda fund, name, kind, w, day="2024-01-01": (fund, name, kind, w, "USD", date.fromisoformat(day), at(0), f"d-{fund}", "e")
    data = [h("f", "g", "fund", "0.5"), h("f", "x", "equity", "0.3"), h("g", "f", "fund", "0.4"), h("g", "y", "equity", "0.6"), h("old", "x", "equity", "1", "2020-01-01")]
    df = spark.createDataFrame(data, "fund_id string, instrument_id string, asset_type string, weight string, currency string, holding_date date, available_at timestamp, disclosure_id string, evidence_id string")
    shares = spark.createDataFrame([("f", "0.5"), ("old", "0.2"), ("none", "0.1")], "fund_id string, weight string")
    leaves = finance.look_through(df, shares, F.lit("2024-02-01").cast("timestamp"))
    got = {(r.instrument_id, r.reason): float(r.weight) for r in leaves.collect()}
    assert got == {("x", "disclosed"): 0.15, ("UNKNOWN:f", "undisclosed"): 0.1, ("UNKNOWN:f", "cycle"): 0.1, ("y", "disclosed"): 0.15, ("UNKNOWN:old", "stale"): 0.2, ("UNKNOWN:none", "missing_disclosure"): 0.1}
    assert float(finance.exposure_summary(leaves).agg(F.sum("weight")).first()[0]) == 0.8


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "node string"))) == Counter([("a",), ("b",), ("c",)])
    assert graph.reachable(edges, spark.createDataFrame([("q",)], "node string")).collect() == []
    assert graph.closes_cycle(edges, "y", "x") and not graph.closes_cycle(edges, "y", "z")
    deps = spark.createDataFrame([("n1", "o"), ("n2", "n1"), ("n3", "z")], "node string, input string")
    assert rows(graph.impacted_nodes(spark.createDataFrame([("o",)], "node string"), deps)) == Counter([("n1",), ("n2",)])
    objects = spark.createDataFrame([(c,) for c in "abcxyz"], "node string")
    kept = graph.collectable(objects, edges.toDF("parent", "child"), spark.createDataFrame([("a",)], "node string"))
    assert rows(kept) == Counter([("x",), ("y",), ("z",)])


def test_quality(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k long, v double, t string")
    b = spark.createDataFrame([(2, 2.0 + 1e-15, None), (3, 4.0, "z"), (4, 1.0, "n")], "k long, v double, t string")
    merged, changed = quality.merge_by_key(a, b, ["k"])
    assert sorted(r.k for r in merged.collect()) == [1, 2, 3, 4] and [r.k for r in changed.collect()] == [3]
    assert {r.k: r.change for r in quality.version_diff(a, b, ["k"]).collect()} == {1: "removed", 2: "changed", 3: "changed", 4: "added"}
    assert quality.multiset_hash(a).collect() == quality.multiset_hash(a.repartition(3)).collect() != quality.multiset_hash(b).collect()
    assert quality.multiset_hash(a.limit(0)).first().rows == 0
    good, bad = quality.quarantine_streams(a, ["t"], F.col("v") > 2.5)
    assert sorted(r.k for r in good.collect()) == [1, 2] and [r.k for r in bad.collect()] == [3]
    assert rows(checks.every_copy_of_duplicates(a.unionByName(a.limit(2)), ["k", "t"]).groupBy("k").count()) == Counter([(1, 2), (2, 2)])
    with pytest.raises(ValidationError):
        quality.validate_price_frame(spark.createDataFrame([("2024-01-01", "a", 1.0, 0.5, 1.0, 1.0, 1.0)], "date string, symbol string, open double, high double, low double, close double, volume double"))
    members = quality.membership_by_replay(spark.createDataFrame([("a",), ("b",)], "symbol string"), spark.createDataFrame([("b", date(2024, 1, 3), "add"), ("c", date(2024, 1, 3), "remove")], "symbol string, date date, action string"), spark.createDataFrame([(date(2024, 1, d),) for d in (2, 3, 4)], "date date"))
    assert rows(members.select(F.dayofmonth("date"), "symbol")) == Counter([(2, "a"), (2, "c"), (3, "a"), (3, "b"), (4, "a"), (4, "b")])
    gap = quality.sequence_breaks(spark.createDataFrame([("s", 1, 0, 1), ("s", 2, 1, 2), ("s", 4, 3, 3)], "k string, sequence long, previous_sequence long, o long"), ["k"], "o")
    assert [r.sequence for r in gap.collect()] == [4]
    rnd = random.Random(9)
    data = [(rnd.choice(["hot"] * 5 + ["b", None]), s := rnd.randint(0, 400), s - rnd.choice([1, 1, 2]), s * 3 + rnd.randint(0, 2)) for _ in range(300)]
    e = spark.createDataFrame(data, "k string, sequence long, previous_sequence long, o long").dropDuplicates(["k", "o"])
    assert rows(quality.sequence_breaks(e, ["k"], "o", 50)) == rows(quality.sequence_breaks(e, ["k"], "o"))


def test_intervals_and_next_start(spark):
    spans = spark.createDataFrame([("v", at(0), at(10), "p"), ("v", at(20), None, "q")], "venue string, opens_at timestamp, closes_at timestamp, phase string")
    points = spark.createDataFrame([("v", at(t)) for t in (0, 9, 10, 25)] + [("w", at(5))], "venue string, t timestamp")
    assert sorted((r.venue, r.t.minute, r.phase or "") for r in asof.interval_lookup(points, spans, "venue", "t", "opens_at", "closes_at", ["phase"]).collect()) == [("v", 0, "p"), ("v", 9, "p"), ("v", 10, ""), ("v", 25, "q"), ("w", 5, "")]
    assert sorted((r.t.minute, r.next_start.minute if r.next_start else -1) for r in asof.next_start(points.where("venue = 'v'"), spans, ["venue"], "t", "opens_at").collect()) == [(0, 0), (9, 20), (10, 20), (25, -1)]


def test_hash_of_a_whole_table(spark, sf, tmp_path):
    import hashlib
    import json

    from tidemark.plans import reference

    def plain(v):
        if isinstance(v, datetime):
            return (v.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
        return v.isoformat() if isinstance(v, date) else v.asDict() if hasattr(v, "asDict") else v

    t = spark.read.parquet(f"{sf}/market_trades.parquet")
    nulls = t.limit(3).withColumns({c: F.lit(None).cast(t.schema[c].dataType) for c in ("price", "event_time", "trading_day", "event_id")})
    whole = t.unionByName(t.limit(50)).unionByName(nulls).coalesce(1)  # repeats and nulls
    whole.write.parquet(f"{tmp_path}/market_trades.parquet")
    hashes = []
    for r in spark.read.parquet(f"{tmp_path}/market_trades.parquet").collect():
        text = json.dumps({c: plain(r[c]) for c in sorted(t.columns)}, separators=(",", ":"), ensure_ascii=False)
        hashes.append(hashlib.sha256(text.encode()).hexdigest())
    assert len(set(hashes)) < len(hashes)
    want = {"rows": len(hashes)} | {f"h{i}": str(sum(int(h[i * 16 : i * 16 + 16], 16) for h in hashes)) for i in range(4)}
    for i in range(8):
        want[f"x{i}"] = 0
        for h in hashes:
            want[f"x{i}"] ^= int(h[i * 8 : i * 8 + 8], 16)
    assert reference.trades_hash(spark, str(tmp_path)).first().asDict() == want


@pytest.mark.parametrize("lag", [0, 1, 3])
def test_days_of_a_calendar(spark, lag):
    rnd = random.Random(lag)
    first = date(2024, 1, 1)
    opens = sorted(rnd.sample(range(5, 60), 25))
    asked = [(i, None if i == 7 else first + timedelta(rnd.randint(0, 70))) for i in range(80)]
    calendar = spark.createDataFrame([(first + timedelta(n),) for n in opens + opens[:3]], "date date")
    got = finance.advance_days(spark.createDataFrame(asked, "_n int, day date"), "day", lag, calendar, "to")
    want = Counter()
    for i, d in asked:
        n = None if d is None else (d - first).days
        later = [] if n is None else ([n] if n in opens else []) if lag == 0 else [x for x in opens if x > n][lag - 1 : lag]
        want[i, d, first + timedelta(later[0]) if later else None] += 1
    assert rows(got) == want
    assert finance.advance_days(spark.createDataFrame(asked[:1], "_n int, day date"), "day", lag, calendar.limit(0), "to").first()["to"] is None


def test_long_paths_and_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n20", "n12"), ("x", "y"), (None, "n3")]
    edges = spark.createDataFrame(chain, "source string, target string")
    start = spark.createDataFrame([("n0",), ("n0",)], "node string")
    assert rows(graph.reachable(edges, start)) == Counter((f"n{i}",) for i in range(1, 21))
    with pytest.raises(ValidationError):
        graph.reachable(edges, start, most=5)
