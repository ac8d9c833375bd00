"""Lifecycles, matching, adjustment models, JSON differences, providers, artifacts, dispatch."""

import json
from collections import Counter
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.dispatch import run_request
from tidemark.operators import finance, lifecycle
from tidemark.operators.checks import ValidationError
from tidemark.sources.artifacts import ArtifactStore
from tidemark.sources.providers import Provider, Registry, fetch_prices, first_that_answers

T0 = datetime(2024, 1, 1, tzinfo=UTC)
EVENT = "event_id string, instrument_id string, kind string, effective_at timestamp, available_at timestamp, symbol string, venue string, universe_id string, successor_id string, evidence_id string"


def event(i, instrument, kind, day, known=None, **more):
    fields = {"symbol": None, "venue": None, "universe_id": None, "successor_id": None} | more
    return (str(i), instrument, kind, T0 + timedelta(days=day), T0 + timedelta(days=day if known is None else known), *fields.values(), f"ev{i}")


def when(day):
    return F.lit(T0 + timedelta(days=day))


def test_lifecycle(spark):
    data = [event(1, "a", "listing", 1, symbol="A", venue="v"), event(2, "a", "symbol_change", 3, symbol="B"), event(3, "a", "symbol_change", 3, 9, symbol="C"), event(4, "a", "entry", 2, universe_id="u"), event(5, "b", "listing", 1, symbol="Q", venue="v"), event(6, "b", "merger", 4, successor_id="a"), event(7, "a", "exit", 8, universe_id="u"), event(8, "c", "entry", 1, universe_id="u")]
    df = spark.createDataFrame(data, EVENT)
    state = {r.instrument_id: r for r in lifecycle.lifecycle_asof(df, when(5), when(5)).collect()}
    assert (state["a"].symbol, state["a"].listed, state["a"].memberships) == ("B", True, ["u"])
    assert (state["b"].listed, state["b"].successor_id) == (False, "a") and state["c"].listed is None
    late = lifecycle.lifecycle_asof(df, when(9), when(9))
    assert {r.instrument_id: (r.symbol, r.memberships) for r in late.collect()}["a"] == ("C", [])
    held = spark.createDataFrame([("b",), ("c",), ("zz",)], "instrument_id string")
    assert Counter(map(tuple, lifecycle.select_universe(lifecycle.lifecycle_asof(df, when(5), when(5)), held, "u").collect())) == Counter([("a", "eligible"), ("b", "retained"), ("c", "unknown"), ("zz", "unknown")])
    with pytest.raises(ValidationError):
        lifecycle.lifecycle_asof(df.unionByName(spark.createDataFrame([event(9, "a", "delisting", 1)], EVENT)), when(5), when(5))
    with pytest.raises(ValidationError):
        lifecycle.lifecycle_asof(df.unionByName(spark.createDataFrame([event(9, "d", "listing", 2, symbol="B", venue="v")], EVENT)), when(5), when(5))


def test_announcements_are_taken_once(spark):
    d = spark.createDataFrame([("s", "d1", date(2024, 1, 5)), ("s", "d2", date(2024, 1, 9)), ("s", "d3", date(2024, 1, 10)), ("t", "d4", date(2024, 1, 1))], "symbol string, dividend_id string, ex_date date")
    a = spark.createDataFrame([("s", "a1", date(2024, 1, 1)), ("s", "a2", date(2024, 1, 3)), ("s", "a3", date(2024, 1, 9)), ("t", "a4", date(2024, 1, 1))], "symbol string, announcement_id string, announced date")
    assert {r.dividend_id: r.announcement_id for r in lifecycle.match_announcements(d, a).collect()} == {"d1": "a2", "d2": "a1", "d3": "a3", "d4": None}


def test_adjustment_models(spark):
    days = [date(2024, 1, d) for d in range(1, 9)]
    close = [50.0, 52.0, 51.0, 25.0, 26.0, 24.0, 25.0, 27.0]
    raw = spark.createDataFrame([(s, d, c) for s in "maz" for d, c in zip(days, close)], "symbol string, date date, close double")
    acts = spark.createDataFrame([(s, days[3], 10.0, 2.0) for s in "maz"], "symbol string, date date, cash double, ratio double")
    by_factor = finance.adjust_prices(raw.where("symbol = 'm'").select("symbol", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")]), acts.where("symbol = 'm'").select("symbol", F.col("date").alias("ex_date"), F.col("cash").alias("cash_per_share"), F.col("ratio").alias("share_ratio"))).select("symbol", "date", "close")
    affine = spark.createDataFrame([("a", d, c if i >= 3 else (c - 10.0) / 2.0) for i, (d, c) in enumerate(zip(days, close))], raw.schema)
    neither = spark.createDataFrame([("z", d, c * (1 + i)) for i, (d, c) in enumerate(zip(days, close))], raw.schema)
    got = {r.symbol: r.model for r in lifecycle.adjustment_model(raw, by_factor.unionByName(affine).unionByName(neither), acts).collect()}
    assert got == {"m": "multiplicative", "a": "affine", "z": None}


def test_cash_identity_and_forecasts(spark):
    pay = spark.createDataFrame([("10", "8.5", "1", ["0.25", "0.25"], "0"), ("10", "8", "1", [], "0"), ("x", "1", "1", [], "0"), (None, "1", "1", [], "0")], "gross string, net string, withholding string, deductions array<string>, rounding string")
    assert lifecycle.cash_identity_breaks(pay).count() == 3
    f = spark.createDataFrame([("a", "large increase", date(2024, 1, 5)), ("a", "increase", date(2024, 1, 4)), ("a", "loss", date(2023, 1, 4))], "symbol string, forecast_type string, announce_date date")
    got = lifecycle.forecast_scores(f, [("large", 2.0), ("increase", 1.0)], F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date"))
    assert sorted((r.forecast_score, r.effective_date.day) for r in got.collect()) == [(1.0, 5), (2.0, 8)]


def test_json_changes(spark):
    df = spark.createDataFrame([(1, '{"a":1.5,"b":[1,2],"c/d":true,"x":{"y":"t"}}', '{"a":2,"b":[1,3],"e":null,"x":{"y":"u"}}'), (2, "{}", None)], "k long, o string, n string")
    got = {(r.path, r.change): r.delta for r in lifecycle.json_changes(df, "o", "n").collect()}
    assert got == {("/a", "modified"): "0.5", ("/b/1", "modified"): "1", ("/c~1d", "removed"): None, ("/e", "added"): None, ("/x/y", "modified"): None}


def test_providers(spark):
    def fetch(symbol, start, end, adjustment):
        return [] if symbol == "none" else [("2024-01-02", 1.0, 2.0, 1.0, 1.5, 3.0, 4.0), ("2025-01-01", 1.0, 2.0, 1.0, 1.5, 3.0, 4.0)]

    def broken(*_):
        raise OSError("down")

    good, bad = Provider("good", fetch, volume_multiplier=100.0, aliases=("g",)), Provider("bad", broken)
    registry = Registry()
    registry.add(good)
    assert registry.get("g") is good and registry.listed(spark, "daily").count() == 1
    for wrong in (("x", "none"), ("good", "qfq")):
        with pytest.raises(ValidationError):
            registry.get(*wrong)
    got = first_that_answers(spark, [bad, good], ["a", "b", "a"], "2024-01-01", "2024-12-31", attempts=2, pause=0.0)
    assert sorted((r.symbol, r.volume) for r in got.collect()) == [("a", 300.0), ("b", 300.0)]
    with pytest.raises(ValidationError):
        fetch_prices(spark, good, ["a", "none"], "2024-01-01", "2024-12-31", pause=0.0)


def test_artifacts(spark, tmp_path):
    store = ArtifactStore(spark, f"file://{tmp_path}/store")
    assert store.collect() == 0
    base = store.put(b"base")
    made = store.put(b"made", owner="me", parents=(base,))
    loose = store.put(b"loose")
    assert store.get(made) == b"made" and store.put(b"made") == made
    with pytest.raises(ValidationError):
        store.delete(base)
    assert [r.node for r in store.unreferenced().collect()] == [loose] and store.collect() == 1
    store.release("me")
    assert store.collect() == 2 and store.objects().count() == 0


def test_dispatch(spark, tmp_path):
    spark.createDataFrame([("u", date(2024, 1, 1), T0, 1.0)], "series_id string, observation_date date, available_at timestamp, value double").write.parquet(f"{tmp_path}/m")
    assert json.loads(run_request(spark, {"operation": "macro", "tables": {"records": f"{tmp_path}/m"}, "options": {"at": "2024-02-01"}}).toJSON().first())["value"] == 1.0
    with pytest.raises(ValidationError):
        run_request(spark, {"operation": "drop", "tables": {}})
