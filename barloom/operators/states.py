"""Discretised market states: occupancy, transitions, a one-step policy and its lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import PCT_BINS, argmax_first, state_index
from barloom.operators.ledger import COMMISSION, SHORT_SHARE
from barloom.operators.positions import BUY, COVER, HOLD, SELL, SHORT, hard_stop_positions
from barloom.operators.series import SERIES, Indicator, SeriesLayout, finite


def with_state(df: DataFrame, position: Column | None = None) -> DataFrame:
    """Add ``state_index`` from the signals, the position (flat by default) and the percent change."""
    return df.withColumn(
        "state_index",
        state_index(F.col("aroon_signal"), F.col("rsi_signal"), F.col("ema_signal"), F.lit(0) if position is None else position, F.col("pct_change")),
    )


def steps(df: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Each row with the state before it and its own return: one observed step per row but the first."""

    order = lay.order()
    columns = {
        "from_state": F.lag("state_index").over(order),
        "step_return": F.try_divide(F.col("close"), F.lag("close").over(order)) - 1.0,
    }
    return finite(df, lay, Indicator((columns,), 1)).filter("from_state is not null")


def transitions(stepped: DataFrame) -> DataFrame:
    """How often each state follows each state."""
    return stepped.groupBy("from_state", F.col("state_index").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


def occupancy(stepped: DataFrame) -> DataFrame:
    """Visits and mean next return per state."""
    return stepped.groupBy(F.col("from_state").alias("state_index")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("step_return").alias("mean_return"),
        F.avg(F.abs("step_return")).alias("mean_move"),
    )


def policy_table(occupied: DataFrame, commission: float = COMMISSION, short_share: float = SHORT_SHARE) -> DataFrame:
    """Mean one-step reward of going flat, long or short in each state: ``(state_index, action, q)``."""
    choices = F.array(
        F.struct(F.lit(HOLD).alias("action"), (-F.col("mean_move")).alias("q")),
        F.struct(F.lit(BUY).alias("action"), (F.col("mean_return") - commission).alias("q")),
        F.struct(F.lit(SHORT).alias("action"), ((-F.col("mean_return")) * short_share - commission * short_share).alias("q")),
    )
    return occupied.select("state_index", F.inline(choices))


def greedy_actions(occupied: DataFrame, commission: float = COMMISSION, short_share: float = SHORT_SHARE) -> DataFrame:
    """The same choice from one row per state: the first largest entry of its vector of rewards."""
    hold, buy = -F.col("mean_move"), F.col("mean_return") - commission
    short = (-F.col("mean_return")) * short_share - commission * short_share
    actions = F.array(*[F.lit(a) for a in (HOLD, BUY, SHORT)])
    return occupied.select("state_index", actions[argmax_first(F.array(hold, buy, short))].alias("action"))


def best_actions(policy: DataFrame) -> DataFrame:
    """The best action of each state, the lowest of equals."""
    return policy.groupBy("state_index").agg(F.max_by("action", F.struct("q", -F.col("action"))).alias("action"))


def apply_policy(df: DataFrame, best: DataFrame) -> DataFrame:
    """Look up the action of each row's state; unknown states hold.

    The table has at most one row per state (1,620), so it is broadcast.
    """
    return df.join(F.broadcast(best), "state_index", "left").withColumn("action", F.coalesce("action", F.lit(HOLD)))


#: Columns with the action of a row when the position before it is flat, long and short.
HELD_ACTIONS = ("action_flat", "action_long", "action_short")


def held_policy_table(occupied: DataFrame, commission: float = COMMISSION, short_share: float = SHORT_SHARE) -> DataFrame:
    """Mean one-step reward of each choice in each state and position: ``(state_index, action, q)``.

    ``occupied`` counts states seen flat. The same market met long or short is another state (its position digit), in which
    staying costs no commission, leaving costs that of one side, and turning that of both.
    """
    up, move, down = F.col("mean_return"), -F.col("mean_move"), -F.col("mean_return") * short_share
    buy, short = F.lit(commission), F.lit(commission * short_share)

    def choice(digit: int, action: int, q: Column) -> Column:
        return F.struct((F.col("state_index") + digit * PCT_BINS).cast("int").alias("state_index"), F.lit(action).alias("action"), q.alias("q"))

    choices = F.array(
        choice(0, HOLD, move), choice(0, BUY, up - buy), choice(0, SHORT, down - short),
        choice(1, HOLD, up), choice(1, SELL, move - buy), choice(1, SHORT, down - buy - short),
        choice(-1, HOLD, down), choice(-1, COVER, move - short), choice(-1, BUY, up - buy - short),
    )
    return occupied.select(F.inline(choices))


def policy_held(df: DataFrame, best: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Play a policy whose state holds the position that its own actions lead to.

    Each row's action is looked up for all three positions (``best`` has at most 1,620 rows, so it is broadcast); a row is
    then a map of positions onto positions, and the fold composes these maps. Adds ``held``, the ``state_index`` met with it,
    the ``action`` taken and the records of ``hard_stop_positions``. Unknown states hold.
    """
    base = F.col("state_index")
    for digit, name in zip((0, 1, -1), HELD_ACTIONS):
        table = best.select((F.col("state_index") - digit * PCT_BINS).alias("_state"), F.col("action").alias(name))
        df = df.join(F.broadcast(table), base == F.col("_state"), "left").drop("_state").withColumn(name, F.coalesce(name, F.lit(HOLD)))
    played = hard_stop_positions(df, lay, actions=HELD_ACTIONS)
    taken = F.when(F.col("held") == 1, F.col("action_long")).when(F.col("held") == -1, F.col("action_short")).otherwise(F.col("action_flat"))
    return played.withColumns({"state_index": (base + F.col("held") * PCT_BINS).cast("int"), "action": taken})
