"""Price series: cleaning, moving averages, setup and trigger signals, cooldown, forward returns.

A series has columns symbol, day, close, high, low, volume and ``i``, the row
number within the symbol. All windows share the partitioning by symbol, so a
chain of these functions shuffles once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.joins import asof_dated


def by_symbol():
    """The rows of a symbol in order. A function, because windows need a session."""
    return Window.partitionBy("symbol").orderBy("i")


@dataclass(frozen=True)
class SignalRules:
    """Thresholds of the signal; the defaults are fixed values of the analysis."""

    peak_window: int = 500
    least_history: int = 120
    drawdown: float = 40.0
    low_drawdown: float = 45.0
    peak_age: int = 120
    range_window: int = 60
    most_range: float = 30.0
    volatility_window: int = 20
    most_volatility: float = 2.5
    density_window: int = 15
    density: int = 10
    short_window: int = 20
    buffer: float = 1.0
    breakout_return: float = 2.0
    expansion_return: float = 5.0
    breakout_volume: float = 1.5
    expansion_volume: float = 2.0
    close_strength: float = 0.65
    confirm_after: int = 2
    hold: float = 0.98
    cooldown: int = 60


def clean_series(prices: DataFrame) -> DataFrame:
    """The last row per symbol and day with a positive finite close, numbered by day."""
    usable = prices.filter((F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf")))
    last = Window.partitionBy("symbol", "day").orderBy(F.col("ingest").desc())
    one = usable.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "ingest")
    return numbered(one)


def numbered(series: DataFrame) -> DataFrame:
    return series.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("day")))


def moving_average(value: str, n: int) -> Column:
    """Mean of the last ``n`` rows; null until there are so many."""
    frame = by_symbol().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def daily_return(value: str = "close") -> Column:
    """Percent change from the row before."""
    before = F.lag(value).over(by_symbol())
    return F.try_divide(F.col(value), before) * 100 - 100


def prior_max(series: DataFrame, value: Column, n: int, out: str) -> DataFrame:
    """Adds the greatest ``value`` of the ``n`` rows before each; null where there are none.

    The maximum of a short frame is looked up at offsets that cover the ``n``
    rows, so a row costs about twice the root of ``n`` and not ``n``. Columns
    named ``_short`` are used inside.
    """
    short = max(isqrt(n), 1)
    found = series.withColumn("_short", F.max(value).over(by_symbol().rowsBetween(-short, -1)))
    offsets = [*range(short, n - short, short), n - short]
    near = [F.col("_short"), *[F.lag("_short", k).over(by_symbol()) for k in offsets if k]]
    return found.withColumn(out, F.greatest(*near) if len(near) > 1 else near[0]).drop("_short")


def setup_features(series: DataFrame, rules: SignalRules) -> DataFrame:
    """What is known of each row from the rows before it: peak, its age, drawdowns, range, volatility.

    Of equal peaks the last counts. Rows without ``least_history`` rows before
    them have no setup.
    """
    prior = lambda n: by_symbol().rowsBetween(-n, -1)
    out = prior_max(series.withColumn("ret", daily_return()), F.struct("close", "i"), rules.peak_window, "_peak")
    out = out.withColumns({"peak": F.col("_peak.close"), "peak_age": F.col("i") - F.col("_peak.i")}).drop("_peak")
    out = out.withColumns(
        {
            "previous": F.lag("close").over(by_symbol()),
            "low_n": F.min("close").over(prior(rules.range_window)), "high_n": F.max("close").over(prior(rules.range_window)),
            "high_short": F.max("close").over(prior(rules.short_window)), "volatility": F.avg(F.abs("ret")).over(prior(rules.volatility_window)),
            "known_volumes": F.count_if(F.col("volume") > 0).over(prior(rules.volatility_window)),
            "mean_volume": F.avg("volume").over(prior(rules.volatility_window)),
        }
    )
    out = out.withColumn("drawdown", (1 - F.try_divide(F.col("previous"), F.col("peak"))) * 100)
    out = out.withColumn("low_drawdown", (1 - F.try_divide(F.col("low_n"), F.col("peak"))) * 100)
    out = out.withColumn("range_pct", F.coalesce(F.try_divide(F.col("high_n") - F.col("low_n"), F.col("low_n")) * 100, F.lit(100.0)))
    deep = (F.col("drawdown") >= rules.drawdown) | (F.col("low_drawdown") >= max(rules.drawdown, rules.low_drawdown))
    calm = (F.col("range_pct") <= rules.most_range) & (F.col("volatility") <= rules.most_volatility)
    setup = (F.col("i") > rules.least_history) & deep & (F.col("peak_age") >= rules.peak_age) & calm
    out = out.withColumn("setup", F.coalesce(setup, F.lit(False)).cast("int"))
    return out.withColumn("setup_days", F.coalesce(F.sum("setup").over(prior(rules.density_window)), F.lit(0)))


def triggers(features: DataFrame, rules: SignalRules, need_volume: bool = True) -> DataFrame:
    """Adds trigger (volume_breakout, volume_expansion or null) and the level that was broken."""
    ratio = F.when((F.col("known_volumes") == rules.volatility_window) & (F.col("volume") > 0), F.col("volume") / F.col("mean_volume"))
    strength = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    out = features.withColumn("volume_ratio", ratio).withColumn("strength", strength)
    out = out.withColumn("breakout_level", F.col("high_n") * (1 + rules.buffer / 100)).withColumn("expansion_level", F.col("high_short") * (1 + rules.buffer / 100))
    loud = lambda least: (F.col("volume_ratio") >= least) if need_volume else (F.col("volume_ratio").isNull() | (F.col("volume_ratio") >= least))
    ready = (F.col("setup_days") >= rules.density) & (F.col("strength") >= rules.close_strength)
    change = F.coalesce("ret", F.lit(0.0))
    breakout = ready & (F.col("close") >= F.col("breakout_level")) & (change >= rules.breakout_return) & loud(rules.breakout_volume)
    expansion = ready & (F.col("close") >= F.col("expansion_level")) & (change >= rules.expansion_return) & loud(rules.expansion_volume)
    out = out.withColumn("trigger", F.when(breakout, "volume_breakout").when(expansion, "volume_expansion"))
    return out.withColumn("level", F.when(breakout, F.col("breakout_level")).when(expansion, F.col("expansion_level")))


def confirmations(triggered: DataFrame, rules: SignalRules) -> DataFrame:
    """Triggers that hold: exactly ``confirm_after`` rows later the close follows and no close fell under the level."""
    k = rules.confirm_after
    out = triggered.withColumn("confirm_i", F.lead("i", k).over(by_symbol())).withColumn("confirm_day", F.lead("day", k).over(by_symbol()))
    out = out.withColumn("confirm_close", F.lead("close", k).over(by_symbol())).withColumn("held_low", F.min("close").over(by_symbol().rowsBetween(0, k)))
    follows = (F.col("confirm_close") >= F.col("close")) & (F.col("held_low") >= F.col("level") * rules.hold)
    return out.filter(F.col("trigger").isNotNull() & F.col("confirm_i").isNotNull() & follows)


def greedy_cooldown(events: DataFrame, by: str, at: str, gap: int, keep: list[str]) -> DataFrame:
    """Events at least ``gap`` after the last one that was kept, by ``by`` in order of ``at``.

    The choice depends on the order, so it is a fold: a task streams its keys'
    rows in order and remembers one time, so a key of any length costs no
    memory. Rows of equal times are taken by ``keep``; rows without a key or a
    time are left out.
    """
    rows = events.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, F.col(at).cast("long").alias(at), *keep)
    return rows.repartition(by).sortWithinPartitions(by, at, *keep).mapInArrow(_spaced(gap), rows.schema)


def _spaced(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for batch in batches:
            kept = []
            for k, (key, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != now or at - last >= gap:
                    now, last = key, at
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def in_pieces(series: DataFrame, run: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = 8192) -> DataFrame:
    """``run`` over pieces of each symbol's rows, so that one long symbol is spread over tasks.

    A row is also sent to the pieces whose rows look back to it, up to
    ``before`` rows, or ahead to it, up to ``after``; what ``run`` makes of these
    copies is dropped. ``run`` must add columns or drop rows by windows
    `by_symbol` that reach no further, and keep the column ``_own``. Symbols of up
    to ``size`` rows stay whole.
    """
    place = F.col("i") - 1
    pieces = F.sequence(F.floor(F.greatest(place - after, F.lit(0)) / size), F.floor((place + before) / size))
    cut = series.withColumn("_piece", F.explode(pieces)).withColumn("_own", F.col("_piece") == F.floor(place / size))
    # The last piece needs no copies behind its rows: they would be pieces of copies only, which own nothing.
    out = run(cut.withColumn("symbol", F.struct("symbol", F.col("_piece").alias("piece"))).drop("_piece")).filter("_own")
    return out.withColumn("symbol", F.col("symbol.symbol")).drop("_own")


def setups(series: DataFrame, rules: SignalRules) -> DataFrame:
    """`setup_features` in pieces of each symbol."""
    return in_pieces(series, lambda s: setup_features(s, rules), rules.peak_window + rules.density_window + 1)


def setup_triggers(series: DataFrame, rules: SignalRules, need_volume: bool = True) -> DataFrame:
    """`triggers` of `setup_features` in pieces of each symbol."""
    return in_pieces(series, lambda s: triggers(setup_features(s, rules), rules, need_volume), rules.peak_window + rules.density_window + 1)


def confirmed(series: DataFrame, rules: SignalRules, need_volume: bool = True) -> DataFrame:
    """`confirmations` in pieces of each symbol."""
    run = lambda s: confirmations(triggers(setup_features(s, rules), rules, need_volume), rules)
    return in_pieces(series, run, rules.peak_window + rules.density_window + 1, rules.confirm_after)


def signals(series: DataFrame, rules: SignalRules = SignalRules(), need_volume: bool = True) -> DataFrame:
    """Confirmed signals after the cooldown: symbol, confirm_i, confirm_day, trigger, level, close."""
    found = confirmed(series, rules, need_volume)
    return greedy_cooldown(found, "symbol", "confirm_i", rules.cooldown, ["confirm_day", "trigger", "level", "confirm_close"])


def forward_metrics(series: DataFrame, horizons: tuple[int, ...], best: str = "close", worst: str = "close") -> DataFrame:
    """Per row and horizon: return, best and worst excursion in percent; null unless the horizon is complete."""
    out = series
    for n in horizons:
        end, frame = F.lead("close", n).over(by_symbol()), by_symbol().rowsBetween(1, n)
        pct = lambda x: (F.try_divide(x, F.col("close")) - 1) * 100
        out = out.withColumn(f"ret_{n}", pct(end))
        out = out.withColumn(f"mfe_{n}", F.when(end.isNotNull(), pct(F.max(F.coalesce(best, "close")).over(frame))))
        out = out.withColumn(f"mae_{n}", F.when(end.isNotNull(), pct(F.min(F.coalesce(worst, "close")).over(frame))))
    return out


def year_end(series: DataFrame) -> DataFrame:
    """Last close of each symbol and year."""
    return series.groupBy("symbol", F.year("day").alias("year")).agg(F.max_by("close", "day").alias("year_close"), F.max("day").alias("year_day"))


def liquidity(series: DataFrame, n: int = 60) -> DataFrame:
    """Median traded value of the last ``n`` rows, last close and number of rows."""
    recent = Window.partitionBy("symbol").orderBy(F.col("i").desc())
    rows = series.withColumn("_n", F.row_number().over(recent))
    value = F.when(F.col("_n") <= n, F.col("close") * F.col("volume"))
    return rows.groupBy("symbol").agg(F.percentile(value, 0.5).alias("median_value"), F.max_by("close", "i").alias("last_close"), F.count(F.lit(1)).alias("n_rows"))


def first_touch(series: DataFrame, discount: float, horizon: int) -> DataFrame:
    """Rows until the low first reaches ``1 - discount`` of the close, within ``horizon`` rows."""
    lows = F.collect_list("low").over(by_symbol().rowsBetween(1, horizon))
    hit = F.array_position(F.transform(lows, lambda x: x <= F.col("close") * (1 - discount)), True)
    return series.withColumn("touch_after", F.when(hit > 0, hit))


def first_reach(events: DataFrame, series: DataFrame, value: str, key: str, at: str, level: str, block: int = 512) -> DataFrame:
    """Adds ``reach_i``, the first row from ``at`` on whose ``value`` is at or under ``level``; null if none is.

    ``events`` has unique ``key``, symbol and the others. Rows are blocks of
    ``block``, blocks are blocks of blocks, and each knows its least value: an
    event looks through the rest of its own, then for the next block, or block of
    blocks, that goes deep enough, and down into it. So no event meets more than
    a few lists of ``block`` entries however long its symbol is.
    """
    rows = series.select(F.col("symbol").alias("s"), (F.col("i") - 1).cast("long").alias("k"), F.col(value).cast("double").alias("v"))
    levels = [rows]
    for _ in range(2):
        levels.append(levels[-1].groupBy("s", F.floor(F.col("k") / block).alias("k")).agg(F.min("v").alias("v")))
    lists = [x.groupBy(F.col("s").alias("l_s"), F.floor(F.col("k") / block).alias("l_k")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("list")) for x in levels]

    def look(left: DataFrame, n: int, parent: Column, least: Column, out: str) -> DataFrame:
        """The first entry of a list from ``least`` on that goes deep enough."""
        met = left.withColumn("_p", parent).join(lists[n], (F.col("symbol") == F.col("l_s")) & (F.col("_p") == F.col("l_k")), "left")
        found = F.filter("list", lambda x: (x["k"] >= least) & (x["v"] <= F.col(level)))
        return met.withColumn(out, F.when(F.size(found) > 0, found[0]["k"])).drop("_p", "l_s", "l_k", "list")

    place = (F.col(at) - 1).cast("long")
    down = lambda k: F.floor(k / block)
    left = look(events.select(key, "symbol", at, level), 0, down(place), place, "_row")
    left = look(left, 1, F.when(F.col("_row").isNull(), down(down(place))), down(place) + 1, "_block")
    done = F.col("_row").isNotNull() | F.col("_block").isNotNull()
    far = levels[2].groupBy(F.col("s").alias("f_s")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("far"))
    left = left.withColumn("_p", F.when(~done, F.col("symbol"))).join(far, F.col("_p") == F.col("f_s"), "left")
    deep = F.filter("far", lambda x: (x["k"] > down(down(place))) & (x["v"] <= F.col(level)))
    left = left.withColumn("_far", F.when(F.size(deep) > 0, deep[0]["k"])).drop("_p", "f_s", "far")
    left = look(left, 1, F.col("_far"), F.lit(0), "_in_far").withColumn("_block", F.coalesce("_block", "_in_far"))
    left = look(left, 0, F.col("_block"), F.lit(0), "_in_block")
    reach = left.select(F.col(key).alias("r_key"), (F.coalesce("_row", "_in_block") + 1).alias("reach_i"))
    return events.join(reach, F.col(key) == F.col("r_key"), "left").drop("r_key")


def holding_variants(events: DataFrame, series: DataFrame, benchmark: DataFrame, key: str, delay: int = 20, discount: float = 0.1) -> DataFrame:
    """Per event: percent returns to the last close when bought at once, ``delay`` rows later, at a limit, and in the benchmark, and their ranks.

    ``events`` has symbol, at (row), price and day. The limit is ``discount``
    under the price and fills on the first row from the event on whose low is at
    or under it. The benchmark (day, index_close) is bought on or after the
    event's day. What can't be bought is null and unranked; of equal returns the
    earlier in this order ranks first.
    """
    ends = series.groupBy(F.col("symbol").alias("e_symbol")).agg(F.max_by("close", "i").alias("last"))
    later = series.select(F.col("symbol").alias("d_symbol"), F.col("i").alias("d_i"), F.col("close").alias("delayed_price"))
    out = events.withColumn("limit", F.col("price") * (1 - discount)).join(ends, F.col("symbol") == F.col("e_symbol")).drop("e_symbol")
    out = out.join(later, (F.col("symbol") == F.col("d_symbol")) & (F.col("at") + delay == F.col("d_i")), "left").drop("d_symbol", "d_i")
    out = first_reach(out, series, "low", key, "at", "limit")
    final = benchmark.agg(F.max_by("index_close", "day").alias("index_last"))
    out = asof_dated(out, benchmark.select("day", "index_close").withColumnRenamed("day", "b_day"), "day", "b_day", ["index_close"], "forward").crossJoin(F.broadcast(final))
    pct = lambda price, last="last": F.round((F.try_divide(F.col(last), price) - 1) * 100, 2)
    returns = {"immediate": pct(F.col("price")), "at_limit": F.when(F.col("reach_i").isNotNull(), pct(F.col("limit"))), "delayed": pct(F.col("delayed_price")), "index": pct(F.col("index_close"), "index_last")}
    out = out.withColumns(returns)
    order = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("r"), F.lit(k).alias("k"))) for k, c in enumerate(returns)])))
    places = F.transform(order, lambda x: x["k"])
    ranked = {f"{c}_rank": F.nullif(F.array_position(places, F.lit(k)).cast("int"), F.lit(0)) for k, c in enumerate(returns)}
    return out.withColumns(ranked).select(key, "symbol", "reach_i", *returns, *ranked)


def sign_changes(series: DataFrame, value: str) -> DataFrame:
    """Per symbol: turns of the value's direction, unchanged steps left out, and whether it ends flat."""
    steps = series.withColumn("_d", F.signum(F.col(value) - F.lag(value).over(by_symbol())))
    moved = steps.filter("_d <> 0").withColumn("_turn", (F.col("_d") != F.lag("_d").over(by_symbol())).cast("int"))
    return moved.groupBy("symbol").agg(F.coalesce(F.sum("_turn"), F.lit(0)).alias("reversals"), F.count(F.lit(1)).alias("moves"))


def trend_summary(series: DataFrame, value: str) -> DataFrame:
    """Recent and earlier four-period means, change, peak share, slope of the last four and z-score."""
    back = Window.partitionBy("symbol").orderBy(F.col("i").desc())
    rows = series.withColumn("_k", F.row_number().over(back))
    v = F.col(value)
    recent, earlier = F.avg(F.when(F.col("_k") <= 4, v)), F.avg(F.when((F.col("_k") > 4) & (F.col("_k") <= 8), v))
    x = F.when(F.col("_k") <= 4, -F.col("_k").cast("double"))
    y = F.when(F.col("_k") <= 4, v)
    n = F.count(y)
    slope = F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), n * F.sum(x * x) - F.sum(x) * F.sum(x))
    past = F.when((F.col("_k") > 1) & (F.col("_k") <= 53), v)
    last = F.max_by(v, F.col("i"))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("points"), last.alias("latest"), recent.alias("recent_avg"), earlier.alias("earlier_avg"),
        (F.try_divide(recent - earlier, earlier) * 100).alias("change_pct"), F.max(v).alias("peak"), F.try_divide(last, F.max(v)).alias("latest_to_peak"),
        slope.alias("slope"), F.try_divide(last - F.avg(past), F.when(F.stddev_pop(past) > 0, F.stddev_pop(past))).alias("z_score"),
        F.avg((v == 0).cast("double")).alias("zero_share"),
    )
