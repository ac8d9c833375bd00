"""Exchange messages (JSON) to typed events: one message gives none, one or several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import fixed_from_text, signed_crc32
from tidemark.sources.lake import ORDINALS

#: Sequences that a provider update may use for its levels.
FACTOR = 1_000_000
_PAIRS = "array<array<string>>"
# Fields of the messages.
CHANNEL = f"arg struct<channel: string, instId: string>, action string, data array<struct<instId: string, ts: string, tradeId: string, px: string, sz: string, side: string, seqId: bigint, prevSeqId: bigint, checksum: bigint, bids: {_PAIRS}, asks: {_PAIRS}, bidPx: string, bidSz: string, askPx: string, askSz: string, markPx: string, fundingRate: string, fundingTime: string, nextFundingTime: string>>"


def _levels(pairs: Column, price_scale: int, quantity_scale: int) -> Column:
    return F.transform(pairs, lambda x: F.struct(fixed_from_text(F.get(x, 0), price_scale).alias("price"), fixed_from_text(F.get(x, 1), quantity_scale).alias("quantity"), F.lit(None).cast("bigint").alias("order_count")))


def _millis(c: str) -> Column:
    return F.timestamp_millis(F.col(c).cast("bigint"))


def _ordinal(messages: DataFrame, arrival: str | None) -> Column:
    """Place of a message in order of arrival: a column, or null where messages have none and go by their receipt."""
    name = arrival or next((c for c in ORDINALS if c in messages.columns), None)
    return (F.lit(None) if name is None else F.col(name)).cast("bigint").alias("_ordinal")


def _provider_chain(rows: DataFrame) -> DataFrame:
    """Book messages with what their provider's ids say: before, fault and _tail, in order of arrival of each symbol.

    rows: one a provider message (snapshots, heartbeats and updates without levels too) with symbol, received_at, kind
    (snapshot or update), first (null where updates are no ranges), update, previous, bids, asks, _ordinal, _pos.
    before: id of the message before. _tail: the sequence emitted last before it, null where the chain is broken.
    A reset (an id below its own previous) ends the chain until the next snapshot.
    """
    by_receipt = lambda c: F.when(F.col("_ordinal").isNull(), F.col(c))
    order = Window.partitionBy("symbol").orderBy("_ordinal", by_receipt("received_at"), by_receipt("update"), "_pos", F.col("kind") != "snapshot")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    snap, p, u, before = F.col("kind") == "snapshot", F.col("previous"), F.col("update"), F.col("before")
    levels = F.coalesce(F.size(F.coalesce("bids", F.array().cast(_PAIRS))) + F.size(F.coalesce("asks", F.array().cast(_PAIRS))), F.lit(0))
    rows = rows.withColumn("_n", levels).withColumn("_reset", F.coalesce(~snap & F.col("first").isNull() & (u < p), F.lit(False)))
    mark = F.when(snap, True).when(F.col("_reset"), False)
    emitted = F.when(snap, u * FACTOR).when((F.col("_n") > 0) & (F.col("first").isNotNull() | p.isNull() | (u > p)), u * FACTOR + F.col("_n"))
    rows = rows.withColumns({"before": F.lag("update").over(order), "_open": F.coalesce(F.last(mark, True).over(earlier), F.lit(False)), "_tail": F.last(emitted, True).over(earlier)})
    fault = (
        F.when(u.isNull(), "id_missing")
        .when(snap, F.when(F.col("_open") & (u <= before), "snapshot_not_advancing"))
        .when(F.col("_reset"), "reset").when(~F.col("_open"), "no_snapshot").when(p.isNull(), "previous_missing").when(p != before, "gap")
        .when(F.col("first").isNotNull() & ~((F.col("first") <= p + 1) & (p + 1 <= u)), "range")
        .when((u == p) & F.col("first").isNull(), F.when(F.col("_n") > 0, "heartbeat_with_levels")).when(u <= p, "not_advancing").when(F.col("_n") >= FACTOR, "too_many_levels")
    )
    return rows.withColumn("fault", fault).withColumn("_tail", F.when(F.col("fault").isNull(), F.col("_tail")))


def _faults(chain: DataFrame) -> DataFrame:
    return chain.where("fault is not null").select("symbol", "kind", "update", "previous", "before", "fault")


def _diff_depth_books(messages: DataFrame, text: str, arrival: str | None) -> DataFrame:
    x = lambda k: F.col("x")[k]
    long = lambda k: x(k).try_cast("bigint")
    received = F.timestamp_millis(F.coalesce(long("received_at"), long("E")))
    snap = x("e") == "depthSnapshot"
    pairs = lambda one, other: F.from_json(F.when(snap, x(one)).otherwise(x(other)), _PAIRS)
    m = messages.select(F.from_json(text, "map<string, string>").alias("x"), _ordinal(messages, arrival)).where(x("e").isin("depthSnapshot", "depthUpdate"))
    head = [x("s").alias("symbol"), F.timestamp_millis(F.coalesce(long("T"), long("E"))).alias("event_time"), received.alias("received_at"), received.alias("available_at")]
    first = F.when(~snap, F.coalesce(long("U"), long("u")))
    return _provider_chain(m.select(*head, "_ordinal", F.lit(0).alias("_pos"), F.when(snap, "snapshot").otherwise("update").alias("kind"), first.alias("first"), F.when(snap, long("lastUpdateId")).otherwise(long("u")).alias("update"), F.when(~snap, long("pu")).alias("previous"), pairs("bids", "b").alias("bids"), pairs("asks", "a").alias("asks")))


def diff_depth_faults(messages: DataFrame, *, text: str = "value", arrival: str | None = None) -> DataFrame:
    """(symbol, kind, update, previous, before, fault) of depth messages that do not follow the one before: by pu, and U to u."""
    return _faults(_diff_depth_books(messages, text, arrival))


def diff_depth_events(messages: DataFrame, *, price_scale: int, quantity_scale: int, text: str = "value", arrival: str | None = None) -> DataFrame:
    """Messages of the kind trade, bookTicker, depthSnapshot, depthUpdate, fundingRate and markPriceUpdate.

    A trade whose buyer is the maker was a sale. Levels of an update are numbered within it; quantity zero deletes. The
    arrays of depthUpdate are the fields b and a, of snapshots bids and asks. Unknown kinds give nothing. arrival: a column
    that numbers messages as they came in, else ingest_ordinal or delivery_id, else they go by receipt and id.
    """
    x = F.from_json(text, "map<string, string>")  # names differ by case only
    m = messages.select(x.alias("x"))
    get = lambda k: F.col("x")[k]
    long = lambda k: get(k).try_cast("bigint")
    received = F.timestamp_millis(F.coalesce(long("received_at"), long("E")))
    head = [get("s").alias("symbol"), F.timestamp_millis(F.coalesce(long("T"), long("E"))).alias("event_time"), received.alias("received_at"), received.alias("available_at")]
    fixed = lambda k, q=False: fixed_from_text(get(k), quantity_scale if q else price_scale)
    levels = lambda k: _levels(F.from_json(get(k), _PAIRS), price_scale, quantity_scale)
    event = lambda kind, name, sequence, *fields: m.where(get("e") == kind).select(*head, sequence.alias("sequence"), F.lit(name).alias("event_type"), *fields)
    trade = event("trade", "trade", long("t"), fixed("p").alias("price"), fixed("q", True).alias("quantity"), F.when(get("m") == "true", "sell").when(get("m") == "false", "buy").alias("aggressor_side"))
    quote = event("bookTicker", "quote", long("u"), fixed("b").alias("bid_price"), fixed("B", True).alias("bid_quantity"), fixed("a").alias("ask_price"), fixed("A", True).alias("ask_quantity"))
    snap = event("depthSnapshot", "book_snapshot", long("lastUpdateId") * FACTOR, levels("bids").alias("bids"), levels("asks").alias("asks"))
    mark = event("markPriceUpdate", "mark_price", long("E"), fixed("p").alias("price"))
    funding = event("fundingRate", "funding_rate", long("E"), get("r").try_cast("double").alias("rate"))
    deltas = numbered_levels(_diff_depth_books(messages, text, arrival).where("kind = 'update'"), price_scale, quantity_scale)
    out = trade
    for part in (quote, snap, mark, funding, deltas):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def numbered_levels(updates: DataFrame, price_scale: int, quantity_scale: int) -> DataFrame:
    """updates (symbol, times, update, bids, asks, _tail) to deltas: level i of update p has sequence p * FACTOR + i.

    previous_sequence is that of the level before it; of the first level it is _tail, null where the provider's chain is
    broken, so that no check takes the update for the next one.
    """
    side = lambda name, c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lit(name).alias("side"), F.get(x, 0).alias("_p"), F.get(x, 1).alias("_q")))
    rows = updates.select("symbol", "event_time", "received_at", "available_at", "update", "_tail", F.posexplode(F.concat(side("bid", "bids"), side("ask", "asks"))).alias("pos", "x")).select("*", "x.*")
    quantity = fixed_from_text(F.col("_q"), quantity_scale)
    sequence = F.col("update") * FACTOR + F.col("pos") + 1
    return rows.select("symbol", "event_time", "received_at", "available_at", sequence.alias("sequence"), F.when(F.col("pos") == 0, F.col("_tail")).otherwise(sequence - 1).alias("previous_sequence"), F.lit("book_delta").alias("event_type"), "side", fixed_from_text(F.col("_p"), price_scale).alias("price"), quantity.alias("quantity"), F.when(quantity["units"] == 0, "delete").otherwise("upsert").alias("action"))


def _channel_rows(messages: DataFrame, text: str, arrival: str | None) -> DataFrame:
    m = messages.select(F.from_json(text, CHANNEL).alias("x"), _ordinal(messages, arrival))
    rows = m.select(F.col("x.arg.channel").alias("channel"), F.col("x.arg.instId").alias("symbol"), F.col("x.action").alias("_action"), "_ordinal", F.posexplode("x.data").alias("_pos", "d")).select("channel", "symbol", "_action", "_ordinal", "_pos", "d.*")
    return rows.withColumn("event_time", _millis("ts")).withColumn("received_at", F.col("event_time")).withColumn("available_at", F.col("event_time"))


def _channel_books(rows: DataFrame) -> DataFrame:
    snap = F.col("_action") == "snapshot"
    books = rows.where("channel = 'books' and _action in ('snapshot', 'update')")
    return _provider_chain(books.select("symbol", "event_time", "received_at", "available_at", "_ordinal", "_pos", F.when(snap, "snapshot").otherwise("update").alias("kind"), F.lit(None).cast("bigint").alias("first"), F.col("seqId").alias("update"), F.when(~snap, F.col("prevSeqId")).alias("previous"), "bids", "asks"))


def channel_faults(messages: DataFrame, *, text: str = "value", arrival: str | None = None) -> DataFrame:
    """(symbol, kind, update, previous, before, fault) of messages of books that do not follow the one before, by prevSeqId."""
    return _faults(_channel_books(_channel_rows(messages, text, arrival)))


def channel_events(messages: DataFrame, *, price_scale: int, quantity_scale: int, text: str = "value", arrival: str | None = None) -> DataFrame:
    """Messages of the channels trades, bbo-tbt, books, mark-price and funding-rate. An update with equal sequence and no levels is a heartbeat.

    arrival: as for diff_depth_events.
    """
    rows = _channel_rows(messages, text, arrival)
    head = ["symbol", "event_time", "received_at", "available_at"]
    fixed = lambda c, q=False: fixed_from_text(F.col(c), quantity_scale if q else price_scale)
    trade = rows.where("channel = 'trades'").select(*head, F.col("tradeId").cast("bigint").alias("sequence"), F.lit("trade").alias("event_type"), fixed("px").alias("price"), fixed("sz", True).alias("quantity"), F.col("side").alias("aggressor_side"))
    quote = rows.where("channel = 'bbo-tbt'").select(*head, F.col("seqId").alias("sequence"), F.lit("quote").alias("event_type"), fixed_from_text(F.get(F.get("bids", 0), 0), price_scale).alias("bid_price"), fixed_from_text(F.get(F.get("bids", 0), 1), quantity_scale).alias("bid_quantity"), fixed_from_text(F.get(F.get("asks", 0), 0), price_scale).alias("ask_price"), fixed_from_text(F.get(F.get("asks", 0), 1), quantity_scale).alias("ask_quantity"))
    books = rows.where("channel = 'books'")
    snap = books.where("_action = 'snapshot'").select(*head, (F.col("seqId") * FACTOR).alias("sequence"), F.lit("book_snapshot").alias("event_type"), _levels(F.col("bids"), price_scale, quantity_scale).alias("bids"), _levels(F.col("asks"), price_scale, quantity_scale).alias("asks"))
    deltas = numbered_levels(_channel_books(rows).where("kind = 'update' and update > previous"), price_scale, quantity_scale)
    mark = rows.where("channel = 'mark-price'").select(*head, F.unix_millis("event_time").alias("sequence"), F.lit("mark_price").alias("event_type"), fixed("markPx").alias("price"))
    funding = rows.where("channel = 'funding-rate'").select(*head, F.unix_millis("event_time").alias("sequence"), F.lit("funding_rate").alias("event_type"), F.col("fundingRate").try_cast("double").alias("rate"), _millis("fundingTime").alias("interval_start"), _millis("nextFundingTime").alias("interval_end"))
    out = trade
    for part in (quote, snap, deltas, mark, funding):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def book_checksum(bids: Column, asks: Column, depth: int = 25) -> Column:
    """Signed CRC-32 of the top levels, bid and ask in turn, as price:size joined by colons; text as the exchange wrote it."""
    pair = lambda side, i: F.when(i < F.size(side), F.concat_ws(":", F.get(F.get(side, i), 0), F.get(F.get(side, i), 1)))
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.array_compact(F.array(pair(bids, i), pair(asks, i)))))
    return signed_crc32(F.array_join(both, ":"))


def canonical_prices(df: DataFrame, *, symbol: str, provider: str, volume_multiplier: float = 1.0, amount_multiplier: float = 1.0, columns: dict[str, str] | None = None) -> DataFrame:
    """Daily bars of any provider: (date, symbol, OHLC, volume in shares, amount in currency, provider)."""
    names = columns or {}
    c = lambda n: F.col(names.get(n, n))
    return df.select(c("date").cast("date").alias("date"), F.lit(symbol).alias("symbol"), *[c(n).cast("double").alias(n) for n in ("open", "high", "low", "close")], (c("volume").cast("double") * volume_multiplier).alias("volume"), (c("amount").cast("double") * amount_multiplier).alias("amount"), F.lit(provider).alias("provider"))


def lots_or_shares(df: DataFrame, lot: int = 100) -> DataFrame:
    """(symbol, unit): whether volume is in shares or lots, by whether the average price of the last five traded days lies within 5% of their range."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    last = df.where("volume > 0").withColumn("_n", n).where("_n <= 5")
    inside = lambda k: F.every((F.col("amount") / (F.col("volume") * k)).between(F.col("low") * 0.95, F.col("high") * 1.05))
    return last.groupBy("symbol").agg(inside(1).alias("_s"), inside(lot).alias("_l")).select("symbol", F.when(F.col("_s"), "shares").when(F.col("_l"), "lots").alias("unit"))


def disclosure_lag(df: DataFrame, value: str) -> DataFrame:
    """Each value a row later per symbol; rows that have none go."""
    return df.withColumn(value, F.lag(value).over(Window.partitionBy("symbol").orderBy("date"))).dropna(subset=[value])


def halts_to_status(symbols: DataFrame, specials: DataFrame, halts: DataFrame, session: Column) -> DataFrame:
    """(symbol, special, status): the last halt listed that covers the session wins, an open one goes on."""
    cover = halts.where((F.col("start") <= session) & (F.col("end").isNull() | (session <= F.col("end")))).groupBy("symbol").agg(F.max_by("status", "position").alias("_halt"))
    out = symbols.select("symbol").distinct().join(specials.select("symbol", F.lit(True).alias("_st")).distinct(), "symbol", "left").join(cover, "symbol", "left")
    return out.select("symbol", F.coalesce("_st", F.lit(False)).alias("special"), F.coalesce("_halt", F.lit("trading")).alias("status"))
