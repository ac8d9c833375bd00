"""Provider records: what gives no terms, what is set aside, what an archive must be."""

import io
import zipfile
from collections import Counter
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.checks import ValidationError
from tidemark.sources import records

ROW = "event_id string, instrument_id string, cash_per_share string, share_ratio string, record_date date, ex_date date, pay_date date, shares_available_date date, captured_at timestamp, source string, kind string"
D, AT = date(2024, 5, 1), datetime(2024, 5, 2, tzinfo=UTC)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_distribution_terms(spark):
    data = [
        ("a", "i", "0.5", "1", D, D, D + timedelta(9), None, AT, "s", "x"), ("b", "i", "0", "1.5", D, D, None, D, AT, "s", "x"), ("c", "i", "1", "2", D, D, D, D, AT, "s", None),
        ("none", "i", "0", "1", D, D, D, D, AT, "s", "x"), ("text", "i", "much", "1", D, D, D, D, AT, "s", "x"), ("late", "i", "0", "2", D, D, D, D + timedelta(1), AT, "s", "x"),
        ("unpaid", "i", "1", "1", D, D, None, D, AT, "s", "x"), ("undated", "i", "1", "1", None, D, D, D, None, "s", "x"), ("below", "i", "-1", "0", D, D, D, D, AT, "s", "x"),
    ]
    df = spark.createDataFrame(data, ROW)
    terms, wrong = records.distribution_terms(df)
    assert Counter((r.evidence_id, r.kind, str(r.effective_at.date())) for r in terms.collect()) == Counter([("a", "dividend_entitlement", "2024-05-01"), ("a", "dividend_payment", "2024-05-10"), ("b", "split", "2024-05-01"), ("c", "dividend_entitlement", "2024-05-01"), ("c", "dividend_payment", "2024-05-01"), ("c", "split", "2024-05-01")])
    found = Counter((r.event_id, r.rule) for r in wrong.collect())
    assert found >= Counter([("none", "no_terms"), ("text", "amounts"), ("late", "deferred_shares"), ("unpaid", "pay_date"), ("undated", "dates"), ("below", "amounts")])
    assert {r[0] for r in found} == {"none", "text", "late", "unpaid", "undated", "below"}
    assert records.distribution_terms(df.limit(0))[0].collect() == []


def test_explicit_terms(spark):
    df = spark.createDataFrame([("1", "merger", "1.5", None), ("2", "merger", None, "x"), ("3", "dividend", "1", "x"), ("4", None, "1", "x"), ("5", "spin_off", None, "x")], "event_id string, kind string, ratio string, successor string")
    kept, wrong = records.explicit_terms(df, {"merger": ["ratio"], "spin_off": ["successor"]})
    assert {r.event_id for r in kept.collect()} == {"1", "5"}
    assert rows(wrong) == Counter([("2", "merger.ratio"), ("3", "kind"), ("4", "kind")])
    with pytest.raises(ValidationError):
        records.explicit_terms(df, {"dividend": ["ratio"]})
    with pytest.raises(ValidationError):
        records.explicit_terms(df, {"merger": ["price"]})


def test_traded_rows(spark):
    data = [("a", 1, 5, 1.0), ("a", 2, 0, None), ("a", 3, 5, 0.0), ("a", 4, None, 1.0), ("a", 5, 1, 1.0), ("a", 5, 1, 1.0), (None, 1, 1, float("nan")), (None, 2, 2, 3.0)]
    df = spark.createDataFrame([(k, d, v, p, p, p, p) for k, d, v, p in data], "k string, d int, volume long, open double, high double, low double, close double")
    traded, idle, wrong = records.traded_rows(df, ["k", "d"])
    assert {(r.k, r.d) for r in traded.collect()} == {("a", 1), (None, 1), (None, 2)}
    assert {(r.k, r.d, r.reason) for r in idle.collect()} == {("a", 2, "untraded")}
    assert rows(wrong) == Counter([("a", 3, "prices"), ("a", 4, "volume"), ("a", 5, "repeated_key"), ("a", 5, "repeated_key")])


def test_indexed_days(spark):
    t = datetime(2024, 1, 1, 23, 59, tzinfo=UTC)
    data = [("i", s, t + timedelta(minutes=m), float(s), 2.0, 1.0) for s, m in ((1, 0), (2, 1), (3, 1), (5, 2), (6, 0))] + [("j", 9, t, 1.0, 1.0, None), (None, 1, t, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "instrument_id string, trade_seq long, traded_at timestamp, price double, index_price double, amount double")
    for size in (2, 1000):
        days, breaks = records.indexed_days(df, slice_rows=size)
        assert rows(days.select("instrument", F.col("day").cast("string"), "open", "close", "trades")) == Counter([("i", "2024-01-01", 2.0, 12.0, 2), ("i", "2024-01-02", 4.0, 10.0, 3), ("j", "2024-01-01", 2.0 / 2, 1.0, 1), (None, "2024-01-01", 1.0, 1.0, 1)])
        assert rows(breaks.select("instrument", "seq", "before")) == Counter([("i", 5, 3), ("i", 6, 5)])


def packed(name: str, text: bytes, **kw) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, text)
        for n, t in kw.items():
            z.writestr(n, t)
    return out.getvalue()


def test_zipped_csv(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(packed("a.csv", "TckrSymb, ClsPric\nX,1.5\n\"Y,Z\",\n".encode("utf-8-sig")))
    (tmp_path / "b.zip").write_bytes(packed("b.csv", b"ClsPric,TckrSymb,More\n2,W,3\n"))
    got = records.read_zipped_csv(spark, f"file://{tmp_path}/*.zip", ["TckrSymb", "ClsPric"])
    assert rows(got.select("TckrSymb", "ClsPric")) == Counter([("X", "1.5"), ("Y,Z", ""), ("W", "2")])
    with pytest.raises(Exception, match="missing columns"):
        records.read_zipped_csv(spark, f"file://{tmp_path}/*.zip", ["Volume"]).collect()
    for bad in (b"<html>", packed("../a.csv", b"x"), packed("a.txt", b"x"), packed("a.csv", b"x", b="y"), packed("a.csv", b"0" * (5 << 20))):
        with pytest.raises(ValidationError):
            records.unpacked(bad)
