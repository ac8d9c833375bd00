"""Returns, labels, quarters, trailing years, look-through of funds, adjustments, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import facts_asof, holdings_asof, point_in_time_join
from tidemark.operators.checks import ValidationError, positive_int, strict
from tidemark.sources.shared import written


def rolling_compound(df: DataFrame, by: list[str], order: str, value: str, window: int, output: str = "compound") -> DataFrame:
    """Compounded return of the last ``window`` rows; null until there are that many, or if one of them is null."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    terms = F.collect_list(F.lit(1.0) + F.col(value)).over(w)
    return df.withColumn(output, F.when(F.count(value).over(w) == window, F.aggregate(terms, F.lit(1.0), lambda a, b: a * b) - 1))


def industry_relative_strength(panel: DataFrame, industry_returns: DataFrame, benchmark: DataFrame, window: int = 20) -> DataFrame:
    """Panel with relative_strength: the compounded return of its industry less that of the benchmark (date, benchmark_return)."""
    own = rolling_compound(industry_returns, ["industry"], "date", "industry_return", window, "_i")
    base = rolling_compound(benchmark.withColumn("_one", F.lit(0)), ["_one"], "date", "benchmark_return", window, "_b")  # one series of days
    rows = own.join(base.select("date", "_b"), "date", "left").select("industry", "date", (F.col("_i") - F.col("_b")).alias("relative_strength"))
    return panel.join(rows, ["industry", "date"], "left").select(*panel.columns, "relative_strength")


def total_return(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """prices (symbol, date, close) with return_close, 100 at the first row: each row multiplies by (close * ratio + cash) / close before.

    actions: symbol, date, ratio (null is 1), cash (null is 0), one of a symbol and date. Days of one action set are
    few beside prices. An action between a symbol's first and last day without a price, repeated days and prices that
    are not positive raise.
    """
    strict(prices.where("close is null or close <= 0 or isnan(close)"), "prices must be positive")
    strict(prices.groupBy("symbol", "date").agg(F.count("*").alias("n")).where("n > 1"), "repeated dates")
    strict(actions.groupBy("symbol", "date").agg(F.count("*").alias("n")).where("n > 1"), "simultaneous actions")
    span = prices.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    strict(actions.join(span, "symbol").where("date between _a and _b").join(prices, ["symbol", "date"], "left_anti"), "action without a price")
    terms = actions.select("symbol", "date", F.coalesce("ratio", F.lit(1.0)).cast("double").alias("_r"), F.coalesce("cash", F.lit(0.0)).cast("double").alias("_c"))
    w = Window.partitionBy("symbol").orderBy("date")
    step = (F.col("close") * F.coalesce("_r", F.lit(1.0)) + F.coalesce("_c", F.lit(0.0))) / F.lag("close").over(w)
    rows = prices.join(terms, ["symbol", "date"], "left").withColumn("_log", F.coalesce(F.ln(step), F.lit(0.0)))
    return rows.withColumn("return_close", 100 * F.exp(F.sum("_log").over(w))).select(*prices.columns, "return_close")


def forward_labels(levels: DataFrame, selections: DataFrame, sessions: DataFrame, *, horizon: int, as_of: Column, terminals: DataFrame | None = None, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """(sample_id, instrument_id, date, label_end, return, status, source, lower_return, upper_return) for every selected sample.

    The label ends ``horizon`` sessions after its date. It is observed if every session in between has a visible level,
    terminal if evidence of the outcome is visible, immature before its end, else missing for the stated reason. The
    sessions (date) are numbered; that table is a calendar.
    """
    positive_int(horizon, "horizon")
    numbered = sessions.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")))  # a calendar
    end_of = numbered.select((F.col("_n") - horizon).alias("_n"), F.col("date").alias("label_end"))
    grid = numbered.join(end_of, "_n", "left")
    strict(selections.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated samples")
    strict(levels.join(numbered, "date", "left_anti"), "levels outside the calendar")
    strict(selections.join(numbered, "date", "left_anti"), "samples outside the calendar")
    seen = levels.where(F.col("available_at") <= as_of).join(grid, "date").select("instrument_id", "date", "value", "_n")
    # a run of sessions without a gap: the number less the rank is constant
    runs = seen.withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy("instrument_id").orderBy("_n")))
    later = runs.select("instrument_id", (F.col("_n") - horizon).alias("_n"), F.col("value").alias("_last"), F.col("_run").alias("_run2"))
    whole = runs.join(later, ["instrument_id", "_n"]).where("_run = _run2").select("instrument_id", "date", (F.col("_last") / F.col("value") - 1).alias("_observed"))
    rows = selections.join(grid.drop("_n"), "date").join(whole, ["instrument_id", "date"], "left")
    if terminals is None:
        rows = rows.withColumn("_terminal", F.lit(None).cast("double")).withColumn("_source", F.lit(None).cast("string"))
    else:
        known = terminals.where((F.col("available_at") <= as_of) & (F.col("date") <= F.to_date(as_of))).select("sample_id", F.col("realized_return").cast("double").alias("_terminal"), F.col("source").alias("_source"), F.col("date").alias("_ended"))
        rows = rows.join(known, "sample_id", "left")
        strict(rows.where("_ended <= date or _ended > label_end"), "terminal outcome outside the label")
    reason = F.coalesce(F.col("missing_reason"), F.lit("missing_price")) if "missing_reason" in selections.columns else F.lit("missing_price")
    mature = F.col("label_end").isNotNull() & (F.col("label_end") <= F.to_date(as_of))
    status = F.when(F.col("_terminal").isNotNull(), "terminal").when(~mature, "immature").when(F.col("_observed").isNotNull(), "observed").otherwise(reason)
    value = F.coalesce("_terminal", F.when(mature, F.col("_observed")))
    bound = lambda b: F.coalesce(value, F.when(status != "immature", F.lit(b).cast("double")))
    return rows.select("sample_id", "instrument_id", "date", "label_end", value.alias("return"), status.alias("status"), F.col("_source").alias("source"), bound(lower).alias("lower_return"), bound(upper).alias("upper_return"))


def label_coverage(labels: DataFrame) -> DataFrame:
    return labels.groupBy("status").agg(F.count("*").alias("samples"), F.count("return").alias("with_return"))


_SERIES = ["instrument_id", "concept", "unit"]


def quarterly_facts(facts: DataFrame, at: Column) -> DataFrame:
    """Reported quarters (60 to 110 days), and differences of cumulative facts of one start where no quarter was reported."""
    days = F.datediff("period_end", "period_start") + 1
    rows = facts_asof(facts, at).where("period_start is not null").withColumn("_days", days)
    columns = [*_SERIES, "period_start", "period_end", "value", "available_at", "accessions", "vintage_consistent", "method"]
    direct = rows.where("_days between 60 and 110").withColumn("accessions", F.array("accession")).withColumn("vintage_consistent", F.lit(True)).withColumn("method", F.lit("reported_quarter")).select(*columns)
    w = Window.partitionBy(*_SERIES, "period_start").orderBy("period_end")
    before = F.lag(F.struct("period_end", "value", "available_at", "accession")).over(w)
    start = F.date_add("_p.period_end", 1)
    derived = rows.withColumn("_p", before).where("_days between 150 and 380 and _p is not null").where((F.datediff("period_end", start) + 1).between(60, 110))
    derived = derived.select(*_SERIES, start.alias("period_start"), "period_end", (F.col("value") - F.col("_p.value")).alias("value"), F.greatest("available_at", "_p.available_at").alias("available_at"), F.array_sort(F.array_distinct(F.array("accession", "_p.accession"))).alias("accessions"), (F.col("accession") == F.col("_p.accession")).alias("vintage_consistent"), F.lit("cumulative_difference").alias("method"))
    keys = [*_SERIES, "period_start", "period_end"]
    derived = derived.join(direct.select(*keys), keys, "left_anti")
    strict(derived.groupBy(*keys).agg(F.count_distinct("value").alias("n")).where("n > 1"), "conflicting cumulative facts")
    one = derived.groupBy(*keys).agg(*[F.max_by(c, F.struct("available_at", "accessions")).alias(c) for c in columns if c not in keys])
    return direct.unionByName(one.select(*columns))


def ttm_facts(facts: DataFrame, at: Column, *, allow_mixed_vintages: bool = False, max_age_days: int = 200) -> DataFrame:
    """The last four quarters of each series if they follow each other, span 330 to 380 days and are fresh."""
    quarters = quarterly_facts(facts, at)
    w = Window.partitionBy(*_SERIES)
    newest = w.orderBy(F.desc("period_end"), F.desc("period_start"))
    rows = quarters.withColumn("_n", F.row_number().over(newest)).withColumn("_next", F.lag("period_start").over(newest)).where("_n <= 4")
    follows = F.col("_next").isNull() | (F.col("_next") == F.date_add("period_end", 1))
    out = rows.groupBy(*_SERIES).agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.sum("value").alias("value"), F.max("available_at").alias("available_at"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("accessions")))), "|").alias("accessions"), F.every("vintage_consistent").alias("vintage_consistent"),
        F.count("*").alias("_count"), F.every(follows).alias("_chain"),
    )
    out = out.where("_count = 4 and _chain").where((F.datediff("period_end", "period_start") + 1).between(330, 380)).where(F.datediff(F.to_date(at), "period_end") <= max_age_days)
    return (out if allow_mixed_vintages else out.where("vintage_consistent")).drop("_count", "_chain")


INCOME, CASH, ASSETS = "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities", "Assets"


def _quality(flows: DataFrame, stocks: DataFrame, suffix: str) -> DataFrame:
    """Return on assets and cash accruals from income, cash and assets of one period end; without each exactly once, none."""
    flow = flows.where((F.col("unit") == "USD") & F.col("concept").isin(INCOME, CASH)).groupBy("instrument_id", "period_start", "period_end")
    one = lambda c, col: F.max(F.when(F.col("concept") == c, F.col(col)))
    f = flow.agg(one(INCOME, "value").alias("_i"), one(CASH, "value").alias("_c"), F.count("*").alias("_n"), F.count_distinct("concept").alias("_k"), F.max("available_at").alias("_t"), F.collect_set("accessions").alias("_acc")).where("_n = 2 and _k = 2")
    a = stocks.where((F.col("unit") == "USD") & (F.col("concept") == ASSETS) & F.col("period_start").isNull()).groupBy("instrument_id", "period_end").agg(F.max("value").alias("_a"), F.count("*").alias("_m"), F.max("available_at").alias("_ta"), F.collect_set("accession").alias("_acc2")).where("_m = 1 and _a > 0")
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(F.concat("_acc", "_acc2"), lambda x: F.split(x, r"\|"))))), "|")
    return f.join(a, ["instrument_id", "period_end"]).select("instrument_id", "period_end", (F.col("_i") / F.col("_a")).alias(f"roa_{suffix}"), ((F.col("_i") - F.col("_c")) / F.col("_a")).alias(f"accruals_{suffix}"), F.greatest("_t", "_ta").alias("available_at"), names.alias("accessions"))


def annual_quality(facts: DataFrame, at: Column, *, max_age_days: int = 550) -> DataFrame:
    visible = facts_asof(facts, at)
    income = visible.where((F.col("concept") == INCOME) & (F.col("unit") == "USD") & F.datediff("period_end", "period_start").between(330, 380))
    last = income.groupBy("instrument_id").agg(F.max(F.struct("period_end", "period_start")).alias("_p")).where(F.datediff(F.to_date(at), "_p.period_end") <= max_age_days)
    flows = visible.join(last, (visible["instrument_id"] == last["instrument_id"]) & (visible["period_start"] == F.col("_p.period_start")) & (visible["period_end"] == F.col("_p.period_end")), "left_semi")
    return _quality(flows.withColumn("accessions", F.col("accession")), visible, "annual")


def ttm_quality(facts: DataFrame, at: Column, *, allow_mixed_vintages: bool = False) -> DataFrame:
    return _quality(ttm_facts(facts, at, allow_mixed_vintages=allow_mixed_vintages), facts_asof(facts, at), "ttm")


def adjust_prices(raw: DataFrame, actions: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Raw bars (symbol, date, ...) with every earlier bar scaled by (close - cash) / (close * ratio) of each later action.

    close is the last raw one before ex_date. A bar's factor is the product over later actions: a running sum of
    logarithms from the end, taken over actions and bars of a symbol together.
    """
    strict(actions.groupBy("symbol", "ex_date").agg(F.count("*").alias("n")).where("n > 1"), "two actions of one day")
    eve = point_in_time_join(actions.withColumn("_eve", F.date_sub("ex_date", 1)), raw.select("symbol", "date", F.col("close").alias("_close")), time="_eve", available="date", by=("symbol",), output="_seen", check=False)
    strict(eve.where("_close is null or not (cash_per_share between 0 and _close) or cash_per_share >= _close or share_ratio <= 0"), "action without a price before it, or out of range")
    factor = F.ln((F.col("_close") - F.col("cash_per_share")) / (F.col("_close") * F.col("share_ratio")))
    marks = eve.select("symbol", F.col("ex_date").alias("date"), factor.alias("_log"), F.lit(0).alias("_bar"))
    names = [c for c in raw.columns if c not in ("symbol", "date")]
    bars = raw.select("symbol", "date", F.lit(None).cast("double").alias("_log"), F.lit(1).alias("_bar"), F.struct(*names).alias("_row"))
    both = bars.unionByName(marks, allowMissingColumns=True)
    # an action scales bars strictly before its day: of one day, bars come first from the end
    later = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_f", F.exp(F.coalesce(F.sum("_log").over(later), F.lit(0.0)))).where("_bar = 1")
    return out.select("symbol", "date", *[(F.col(f"_row.{c}") * F.col("_f")).alias(c) if c in columns else F.col(f"_row.{c}").alias(c) for c in names])


def look_through(holdings: DataFrame, allocations: DataFrame, at: Column, *, max_depth: int = 8, max_age_days: int = 180) -> DataFrame:
    """(instrument_id, weight, currency, path, reason, holding_date, evidence_id, known): what allocations to funds hold in the end.

    allocations: fund_id, weight (decimal). Funds of funds are opened level by level; cycles, funds beyond max_depth,
    without or with a stale disclosure, and undisclosed parts stay as UNKNOWN leaves, so that weights add up.
    """
    exact = "decimal(38,18)"
    visible = holdings_asof(holdings, at).select("fund_id", "holding_date", F.struct("instrument_id", "asset_type", "currency", F.col("weight").cast(exact).alias("weight"), "evidence_id").alias("_h"))
    books = visible.groupBy("fund_id").agg(F.max("holding_date").alias("holding_date"), F.collect_list("_h").alias("_rows"))  # one disclosure
    books = written(books, "books")
    total = allocations.agg(F.sum(F.col("weight").cast(exact))).first()[0] or 0
    if total > 1:
        raise ValidationError("allocations exceed the whole")
    nothing = F.lit(None).cast("string")
    front = allocations.select(F.col("fund_id"), F.col("weight").cast(exact).alias("weight"), F.array().cast("array<string>").alias("path"))
    leaves = None
    for depth in range(max_depth + 1):
        asked = front.join(books, "fund_id", "left").withColumn("_here", F.concat("path", F.array("fund_id")))
        stale = F.datediff(F.to_date(at), "holding_date") > max_age_days
        reason = F.when(F.array_contains("path", F.col("fund_id")), "cycle").when(F.lit(depth >= max_depth), "depth_limit").when(F.col("_rows").isNull(), "missing_disclosure").when(stale, "stale")
        asked = written(asked.withColumn("reason", reason), f"depth-{depth}")
        unknown = F.concat(F.lit("UNKNOWN:"), F.col("fund_id"))
        shut = asked.where("reason is not null").select(unknown.alias("instrument_id"), "weight", nothing.alias("currency"), F.col("_here").alias("path"), "reason", F.when(F.col("reason") == "stale", F.col("holding_date")).alias("holding_date"), nothing.alias("evidence_id"))
        opened = asked.where("reason is null")
        disclosed = F.aggregate("_rows", F.lit(0).cast(exact), lambda a, r: (a + r["weight"]).cast(exact))
        rest = opened.select(unknown.alias("instrument_id"), (F.col("weight") * (1 - disclosed)).cast(exact).alias("weight"), nothing.alias("currency"), F.col("_here").alias("path"), F.lit("undisclosed").alias("reason"), "holding_date", nothing.alias("evidence_id"))
        rows = opened.select("_here", "holding_date", F.col("weight").alias("_w"), F.inline("_rows"))
        rows = rows.withColumn("_part", (F.col("_w") * F.col("weight")).cast(exact))
        held = rows.where("asset_type <> 'fund'").select("instrument_id", F.col("_part").alias("weight"), "currency", F.col("_here").alias("path"), F.lit("disclosed").alias("reason"), "holding_date", "evidence_id")
        found = shut.unionByName(rest).unionByName(held).where("weight <> 0")
        leaves = found if leaves is None else leaves.unionByName(found)
        front = rows.where("asset_type = 'fund'").select(F.col("instrument_id").alias("fund_id"), F.col("_part").alias("weight"), F.col("_here").alias("path"))
        if front.isEmpty():
            break
    return leaves.withColumn("known", F.col("reason") == "disclosed")


def exposure_summary(leaves: DataFrame) -> DataFrame:
    """(instrument_id, currency, known, weight)."""
    key = F.when(F.col("known"), F.col("instrument_id")).alias("instrument_id")
    return leaves.groupBy(key, F.when(F.col("known"), F.col("currency")).alias("currency"), "known").agg(F.sum("weight").alias("weight"))


def trading_units(df: DataFrame, *, volume_unit: str, amount_unit: str, currency: str, lot_size: int | None = None) -> DataFrame:
    """volume in shares and amount in currency units, tagged."""
    scale = {"currency": 1, "thousand_currency": 1000, "ten_thousand_currency": 10000}
    if volume_unit not in ("shares", "lots") or amount_unit not in scale or len(currency) != 3 or not currency.isupper():
        raise ValidationError("unsupported unit or currency")
    lots = positive_int(lot_size, "lot_size") if volume_unit == "lots" else 1
    strict(df.where("volume < 0 or amount < 0 or isnan(cast(volume as double)) or isnan(cast(amount as double))"), "invalid volume or amount")
    return df.withColumns({"volume": F.col("volume") * lots, "amount": F.col("amount") * scale[amount_unit], "volume_unit": F.lit("shares"), "amount_unit": F.lit("currency"), "share_basis": F.lit("raw"), "currency": F.lit(currency)})


def merge_distributions(rows: DataFrame) -> DataFrame:
    """Per-ten amounts of a symbol and ex_date to one per-share action; parts of one day must agree on all other dates."""
    key = ["symbol", "ex_date"]
    dates = F.struct("announced_date", "record_date", "pay_date")
    out = rows.groupBy(*key).agg((F.sum("cash_per_ten") / 10).alias("cash_per_share"), (1 + F.sum("shares_per_ten") / 10).alias("share_ratio"), F.count_distinct(dates).alias("_n"), F.first(dates).alias("_d"))
    strict(out.where("_n > 1").select(*key), "parts of one distribution disagree on dates")
    return out.select(*key, "_d.*", "cash_per_share", "share_ratio")


def advance_days(df: DataFrame, date: str, lag: int, open_days: DataFrame, output: str) -> DataFrame:
    """The ``lag``-th open day strictly after date; 0 asks for date itself, which must be open. Null beyond the calendar.

    open_days (date) is a calendar. Its days are numbered, and each date between them gets the number of the last open
    day; rows meet that table, of one row a date, by equality.
    """
    days = open_days.select(F.col("date").cast("date").alias("_day")).where("_day is not null").distinct()
    by_day = Window.orderBy("_day")  # a calendar
    numbered = days.select("_day", F.row_number().over(by_day).alias("_n"), F.lead("_day").over(by_day).alias("_next"))
    until = F.coalesce(F.date_sub("_next", 1), F.col("_day"))
    dates = numbered.select(F.explode(F.sequence("_day", until)).alias("_date"), "_n")
    ends = days.agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))  # one row
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(date).cast("date").alias("_own")).join(F.broadcast(ends))
    own, early = F.col("_own"), F.col("_own") < F.col("_first")
    at = F.when(early, F.col("_first")).when(own > F.col("_last"), F.col("_last")).otherwise(own)
    rows = rows.select("_row", "_own", early.cast("int").alias("_before"), at.alias("_date")).join(dates, "_date", "left")
    target = numbered.select(F.col("_n").alias("_to"), F.col("_day").alias("_found"))
    out = rows.withColumn("_to", F.col("_n") - F.col("_before") + lag).join(target, "_to", "left")
    found = F.when(F.col("_found") == own, F.col("_found")) if lag == 0 else F.col("_found")
    return out.select(*[F.col(f"_row.`{c}`") for c in df.columns], found.alias(output))
