"""Event and reference schemas, and the rules of their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import fixed_value
from tidemark.operators.checks import ValidationError, violations

_FP = "struct<units: bigint, scale: smallint>"
_LEVELS = f"array<struct<price: {_FP}, quantity: {_FP}, order_count: bigint>>"
HEADER = "event_type string, event_id string, instrument_id string, event_time timestamp, received_at timestamp, available_at timestamp, source string, trading_day date, session_id string, sequence bigint"
KNOWLEDGE = "effective_from timestamp, effective_to timestamp, available_at timestamp, superseded_at timestamp"

# Names and types of the records that are exchanged.
EVENTS = {
    "quote": f"bid_price {_FP}, bid_quantity {_FP}, ask_price {_FP}, ask_quantity {_FP}",
    "trade": f"price {_FP}, quantity {_FP}, aggressor_side string",
    "bar": f"bar_start timestamp, bar_end timestamp, open_price {_FP}, high_price {_FP}, low_price {_FP}, close_price {_FP}, volume {_FP}, is_complete boolean",
    "book_snapshot": f"bids {_LEVELS}, asks {_LEVELS}",
    "book_delta": f"side string, action string, price {_FP}, quantity {_FP}, previous_sequence bigint",
    "funding_rate": "rate double, interval_start timestamp, interval_end timestamp",
    "mark_price": f"price {_FP}",
    "corporate_action": f"action_type string, effective_date date, ratio {_FP}, cash_amount {_FP}, currency string",
    "status": "status string, reason string",
}
REFERENCES = {
    "instrument_spec": f"instrument_id string, asset_class string, product_type string, venue string, native_symbol string, settlement_currency string, price_tick {_FP}, quantity_step {_FP}, contract_multiplier {_FP}, {KNOWLEDGE}",
    "symbol_mapping": f"source string, provider_symbol string, instrument_id string, {KNOWLEDGE}",
    "trading_session": "session_id string, calendar_id string, venue string, trading_day date, phase string, opens_at timestamp, closes_at timestamp, available_at timestamp, superseded_at timestamp",
}
OPTIONAL = {"corporate_action": {"ratio", "cash_amount", "currency"}}


def schema(kind: str) -> T.StructType:
    if kind in EVENTS:
        return T.StructType.fromDDL(f"{HEADER}, {EVENTS[kind]}") if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(f"{HEADER}, {EVENTS[kind]}")
    if kind in REFERENCES:
        return T.StructType.fromDDL(REFERENCES[kind]) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(REFERENCES[kind])
    raise ValidationError(f"unknown schema {kind}")


def conform(df: DataFrame, kind: str, *, ordinal: str | None = None) -> DataFrame:
    """df with exactly the schema's columns in order; another type or a missing column raises, other columns are dropped.

    ordinal: a whole number that says in what order rows came in, kept as the last column.
    """
    want, have = schema(kind), {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = {f.name: have.get(f.name) for f in want if have.get(f.name) != f.dataType.simpleString()}
    if wrong:
        raise ValidationError(f"{kind}: {wrong}")
    if ordinal is not None and have.get(ordinal) not in ("bigint", "int"):
        raise ValidationError(f"{kind}: {ordinal} is not a whole number: {have.get(ordinal)}")
    return df.select(*want.names, *([] if ordinal is None or ordinal in want.names else [ordinal]))


def _fixed(c: str, strict: bool = True) -> Column:
    value = F.col(c)
    return F.coalesce(value["scale"].between(0, 18) & ((value["units"] > 0) if strict else (value["units"] >= 0)), F.lit(False))


def _side(c: str, down: bool) -> Column:
    prices = F.transform(F.col(c), lambda x: x["price"]["units"])
    ordered = F.sort_array(prices, not down)
    return (F.size(prices) > 0) & (prices == ordered) & (F.size(F.array_distinct(prices)) == F.size(prices))


def _interval() -> Column:
    return (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("effective_from"))) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("available_at")))


def rules(kind: str) -> dict[str, Column]:
    """Rule -> condition that holds for a right row."""
    c = F.col
    header = {
        "complete": reduce(lambda a, b: a & b, [c(n).isNotNull() for n in schema(kind).names if n not in OPTIONAL.get(kind, set()) | {"effective_to", "superseded_at"}]),
    }
    if kind in EVENTS:
        header |= {"kind": c("event_type") == kind, "text": reduce(lambda a, b: a & b, [F.trim(n) != "" for n in ("event_id", "instrument_id", "source", "session_id")]), "clocks": (c("event_time") <= c("received_at")) & (c("received_at") <= c("available_at"))}
    scale = lambda *names: reduce(lambda a, b: a & b, [c(n)["scale"] == c(names[0])["scale"] for n in names])
    ohlc = ("open_price", "high_price", "low_price", "close_price")
    own = {
        "quote": lambda: {"positive": _fixed("bid_price") & _fixed("ask_price") & _fixed("bid_quantity", False) & _fixed("ask_quantity", False), "one_scale": scale("bid_price", "ask_price"), "uncrossed": fixed_value(c("bid_price")) <= fixed_value(c("ask_price"))},
        "trade": lambda: {"positive": _fixed("price") & _fixed("quantity"), "side": c("aggressor_side").isin("buy", "sell", "unknown")},
        "bar": lambda: {"interval": (c("bar_end") > c("bar_start")) & (c("event_time") == c("bar_end")), "positive": reduce(lambda a, b: a & b, map(_fixed, ohlc)) & _fixed("volume", False), "one_scale": scale(*ohlc), "bounds": (c("high_price.units") >= F.greatest(*[c(f"{n}.units") for n in ohlc])) & (c("low_price.units") <= F.least(*[c(f"{n}.units") for n in ohlc]))},
        "book_snapshot": lambda: {"ordered": _side("bids", True) & _side("asks", False), "uncrossed": F.get("bids", 0)["price"]["units"] < F.get("asks", 0)["price"]["units"], "one_scale": F.size(F.array_distinct(F.transform(F.concat("bids", "asks"), lambda x: x["price"]["scale"]))) == 1, "positive": F.forall(F.concat("bids", "asks"), lambda x: (x["price"]["units"] > 0) & (x["quantity"]["units"] >= 0))},
        "book_delta": lambda: {"side": c("side").isin("bid", "ask"), "sequence": c("previous_sequence") < c("sequence"), "positive": _fixed("price") & _fixed("quantity", False), "action": ((c("action") == "delete") & (c("quantity.units") == 0)) | ((c("action") == "upsert") & (c("quantity.units") > 0))},
        "funding_rate": lambda: {"finite": ~F.isnan("rate") & (F.abs("rate") < float("inf")), "interval": c("interval_end") > c("interval_start")},
        "mark_price": lambda: {"positive": _fixed("price")},
        "corporate_action": lambda: {"terms": c("ratio").isNotNull() | c("cash_amount").isNotNull(), "nonnegative": (c("ratio").isNull() | _fixed("ratio", False)) & (c("cash_amount").isNull() | _fixed("cash_amount", False)), "currency": c("cash_amount").isNotNull() == c("currency").isNotNull()},
        "status": lambda: {},
        "instrument_spec": lambda: {"positive": _fixed("price_tick") & _fixed("quantity_step") & _fixed("contract_multiplier"), "intervals": _interval()},
        "symbol_mapping": lambda: {"intervals": _interval()},
        "trading_session": lambda: {"interval": (c("closes_at") > c("opens_at")) & (c("superseded_at").isNull() | (c("superseded_at") > c("available_at")))},
    }[kind]()
    return header | own


def record_violations(df: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    return violations(df, rules(kind), keep)
