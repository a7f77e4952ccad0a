"""Made-up prices for figures of a catalogue: a walk back from today's value, sales, snapshots and asks.

All chance comes from a generator of 32-bit words whose state only counts up, so the n-th draw of a seed is a column
expression of seed and n, and any draw can be had without those before it. What is sequential stays within a
figure: the walk, and how many draws each day takes, are folds over that figure's days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.semantics import half_up

# Fixed values of the generator and of the histories made with it.
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF
BUSY_UNDER_USD, BUSY, QUIET, USED_FACTOR, SPREAD, ASK_FACTOR = 300, 4.0, 2.2, 0.72, 0.18, 1.12
CONDITIONS = ("NEW_SEALED", "USED_COMPLETE")


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit words, without overflow of 64 bits."""
    return ((a.bitwiseAND(0xFFFF) * b) + F.shiftleft((F.shiftright(a, 16) * b.bitwiseAND(0xFFFF)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def draw(seed: Column, n: Column) -> Column:
    """The n-th number of a seed, n from 1: at least 0 and less than 1."""
    state = (seed.cast("long").bitwiseAND(MASK) + n.cast("long") * STEP).bitwiseAND(MASK)
    first = lambda s: _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(1))
    second = lambda t: (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(MASK).bitwiseXOR(t)
    mixed = let(let(let(state, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14)))
    return mixed / F.lit(float(1 << 32))


def walks(figures: DataFrame, days: int) -> DataFrame:
    """figures with walk: values of days days, the oldest first and the last market_usd.

    figures: figure_id, seed, market_usd, drift (a year), volatility (a day), floor_usd.
    """
    shock = lambda n: (draw(F.col("seed"), n) - 0.5) * 2 * F.col("volatility")
    before = lambda values, n: F.greatest(F.element_at(values, -1) / (1 + F.col("drift") / 365 + shock(n)), F.col("floor_usd"))
    today = F.array(F.col("market_usd").cast("double"))
    back = F.aggregate(F.sequence(F.lit(1), F.lit(days - 1)), today, lambda values, n: F.concat(values, F.array(before(values, n)))) if days > 1 else today
    return figures.withColumn("walk", F.reverse(back))


def daily_sales(base: Column, seed: Column, drawn: Column) -> Column:
    """How many sales a day has, from the next draw: dear figures sell less often."""
    return F.floor(draw(seed, drawn + 1) * F.when(base > BUSY_UNDER_USD, QUIET).otherwise(BUSY))


def counted(figures: DataFrame, days: int) -> DataFrame:
    """figures with walk, and drawn: how many draws come before each day and condition, and after the last one."""
    last = lambda x: F.element_at(x["drawn"], -1)
    base = lambda x, k: F.get(x["walk"], (k / 2).cast("int"))
    taken = lambda x, k: last(x) + 1 + daily_sales(base(x, k), F.col("seed"), last(x))
    # the walk goes along in the state, so that it is made once and not at each step
    start = F.struct(F.col("walk"), F.array(F.lit(days).cast("long")).alias("drawn"))
    state = F.aggregate(F.sequence(F.lit(0), F.lit(2 * days - 1)), start, lambda x, k: F.struct(x["walk"].alias("walk"), F.concat(x["drawn"], F.array(taken(x, k))).alias("drawn")))
    return walks(figures, days).withColumn("drawn", state["drawn"])


def sales(figures: DataFrame, days: int) -> DataFrame:
    """figure_id, condition, days_ago, k (from 0 within day and condition), amount_usd."""
    # outer, since a plain one is led by a filter for empty arrays, which would make walk and draws once more
    steps = counted(figures, days).select("figure_id", "seed", "walk", F.posexplode_outer(F.slice("drawn", 1, 2 * days)).alias("step", "before"))
    day = (F.col("step") / 2).cast("int")
    rows = steps.select("figure_id", "seed", "before", day.alias("day"), (F.col("step") % 2).alias("used"), F.get("walk", day).alias("base"))
    n = daily_sales(F.col("base"), F.col("seed"), F.col("before"))
    rows = rows.withColumn("k", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))).filter("k IS NOT NULL")
    spread = 1 + (draw(F.col("seed"), F.col("before") + 2 + F.col("k")) - 0.5) * SPREAD
    price = half_up(F.col("base") * F.when(F.col("used") == 0, 1.0).otherwise(USED_FACTOR) * spread)
    condition = F.when(F.col("used") == 0, CONDITIONS[0]).otherwise(CONDITIONS[1])
    return rows.select("figure_id", condition.alias("condition"), (days - 1 - F.col("day")).alias("days_ago"), "k", price.alias("amount_usd"))


def snapshots(sold: DataFrame) -> DataFrame:
    """Of each day and condition with sales: least, median, mean and greatest price, their number, and an ask above the least."""
    price = F.col("amount_usd")
    mean = F.sum(price.cast("decimal(20,2)")).cast("double") / F.count(price)
    return sold.groupBy("figure_id", "condition", "days_ago").agg(
        F.min(price).alias("min_usd"), half_up(F.median(price)).alias("median_usd"), half_up(mean).alias("avg_usd"), F.max(price).alias("max_usd"), F.count("*").alias("sample_size"), half_up(F.min(price) * ASK_FACTOR).alias("lowest_ask_usd")
    )


def asks(figures: DataFrame, days: int) -> DataFrame:
    """Two to five live asks of each figure, above its market value: figure_id, k, condition, amount_usd."""
    # the rows of a lone array, so that the count of draws is made once
    rows = counted(figures, days).select("figure_id", "seed", "market_usd", F.explode_outer(F.array(F.element_at("drawn", -1))).alias("before"))
    n = 2 + F.floor(draw(F.col("seed"), F.col("before") + 1) * 4)
    rows = rows.withColumn("k", F.explode_outer(F.sequence(F.lit(0).cast("long"), n - 1)))
    markup = 1.05 + draw(F.col("seed"), F.col("before") + 2 + F.col("k")) * 0.35
    return rows.select("figure_id", "k", F.when(F.col("k") % 3 == 0, CONDITIONS[1]).otherwise(CONDITIONS[0]).alias("condition"), half_up(F.col("market_usd") * markup).alias("amount_usd"))
