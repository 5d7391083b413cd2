"""Inter-arrival times, the queue panel and its service-level bounds.

A slot's summary says what follows from its own snapshots alone: opening and
closing stock, the last check-in and check-out, sums over settled moments.  What
depends on earlier slots is the first change of a slot and the first gap of a
name and address in it.  Summaries are chained by windows over rolled-up rows, of
which a station has at most 144 a day, and only those first changes and gaps are
corrected: raw rows are exchanged once and never joined to their own roll-up for
the queue panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dockflow.functions import calendar as cal
from dockflow.functions import queueing
from dockflow.functions.flows import check_in, check_out
from dockflow.operators.layout import spread
from dockflow.plans.panel import CHRONOLOGICAL, SLOT, TIEBREAK, entry, inside, slots

TARGET = 30
T_START, T_END = 10.0, 6.0

#: A station's rows of one name, address and slot.
PLACE = ("number", "name", "address", "date", "slot")


def with_known_events(rows: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """``in_seen`` / ``out_seen``: the last check-in / -out of the same name and
    address before the row, as far as the slot's own rows tell.  The first row of a
    slot, whose change is not known here, counts as none."""
    before = W.partitionBy(*SLOT, "name", "address").orderBy("last_update", *tiebreak).rowsBetween(W.unboundedPreceding, -1)
    at = lambda happened: F.last(F.when(happened, F.col("last_update")), ignorenulls=True).over(before)
    return rows.withColumns({"in_seen": at(F.col("change") > 0), "out_seen": at(F.col("change") < 0)})


def summary_columns() -> list[Column]:
    """What a rolled-up row keeps for the chain."""
    at = lambda happened: F.max(F.when(happened, F.col("last_update")))
    return [
        F.max(F.when(F.col("seat") == 1, F.col("available_bike_stands"))).alias("opening"),
        at(F.col("seat") == 1).alias("opened_at"),
        F.max("closing").alias("closing"),
        F.min("last_update").alias("first"),
        at(F.col("change") > 0).alias("last_in"),
        at(F.col("change") < 0).alias("last_out"),
    ]


def chained(rolled: DataFrame, order: str) -> DataFrame:
    """Adds what earlier slots tell: ``entry`` (the slot's first change, on the row
    that holds its opening snapshot), ``first_update`` of the station, and of the
    name and address ``in_before`` / ``out_before``, the last check-in / -out of
    earlier slots, and ``opened_in`` / ``opened_out``, that of the opening snapshot."""
    rows = rolled.withColumns({"entry": entry(order), "first_update": F.min("first").over(W.partitionBy("number"))})
    rows = rows.withColumns(
        {"opened_in": F.when(F.col("entry") > 0, F.col("opened_at")), "opened_out": F.when(F.col("entry") < 0, F.col("opened_at"))}
    )
    earlier = W.partitionBy("number", "name", "address").orderBy("date", "slot").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns(
        {
            "in_before": F.max(F.coalesce("last_in", "opened_in")).over(earlier),
            "out_before": F.max(F.coalesce("last_out", "opened_out")).over(earlier),
        }
    )


def gap(happened: Column, seen: str, opened: str, before: str) -> Column:
    """Minutes since the last such event; NULL without one, or if none happened.
    The opening snapshot comes before all other events of its slot."""
    last = F.when(F.col("seat") == 1, F.col(before)).otherwise(F.coalesce(seen, opened, before))
    return F.when(happened, cal.minutes_between(last, F.col("last_update")))


def with_interarrival(
    snapshots: DataFrame, order: str = CHRONOLOGICAL, tiebreak: Sequence[str] = TIEBREAK, distinct: bool = True
) -> DataFrame:
    """Every snapshot with its change, check-in, check-out, the station's first time,
    and ``cust_ia`` / ``service_ia``: minutes since the previous check-in / -out.

    Counted over the rows with a check-in (check-out) of the same number, name
    and address; NULL on other rows and on the first one.  What earlier slots tell
    is one row per slot, joined on the keys by which the slots already lie.
    """
    rows = with_known_events(inside(slots(snapshots, tiebreak, distinct)), tiebreak)
    known = chained(rows.groupBy(*PLACE).agg(*summary_columns()), order)
    names = ["name", "address", "in_before", "out_before", "opened_in", "opened_out"]
    told = known.groupBy(*SLOT).agg(
        F.max(F.when(F.col("opening").isNotNull(), F.col("entry"))).alias("entry"),
        F.max("first_update").alias("first_update"),
        F.collect_list(F.struct(*names)).alias("_names"),
    )
    rows = rows.join(told, list(SLOT))
    mine = F.filter("_names", lambda x: x["name"].eqNullSafe(F.col("name")) & x["address"].eqNullSafe(F.col("address")))
    rows = rows.withColumn("_mine", F.get(mine, F.lit(0)))
    rows = rows.withColumns({c: F.col("_mine")[c] for c in names[2:]})
    change = F.coalesce("change", "entry", F.lit(0)).cast("bigint")
    rows = rows.withColumn("prev_period_diff", change)
    rows = rows.withColumns({"check_in": check_in(F.col("prev_period_diff")), "check_out": check_out(F.col("prev_period_diff"))})
    return rows.withColumns(
        {
            "cust_ia": gap(F.col("check_in") != 0, "in_seen", "opened_in", "in_before"),
            "service_ia": gap(F.col("check_out") != 0, "out_seen", "opened_out", "out_before"),
        }
    ).drop("change", "closing", "in_seen", "out_seen", "entry", "_names", "_mine", *names[2:])


def joined_interarrival(rows: DataFrame) -> DataFrame:
    """Inter-arrival times joined back on (number, last_update), first gap closed.

    Where a station has several rows of one moment the join pairs each with
    every event of that moment.  The events of a moment sit in the row's own
    window partition, so the pairing is an explode instead of two joins.  A
    first event without a predecessor counts from the station's first row.
    """
    moment = W.partitionBy(*SLOT, "last_update")
    ins = F.collect_list(F.when(F.col("check_in") != 0, F.struct("cust_ia"))).over(moment)
    outs = F.collect_list(F.when(F.col("check_out") != 0, F.struct("service_ia"))).over(moment)
    paired = rows.withColumns({"_ins": ins, "_outs": outs}).drop("cust_ia", "service_ia")
    paired = paired.withColumn("_i", F.explode_outer("_ins"))
    paired = paired.withColumn("_o", F.explode_outer("_outs"))
    since_first = cal.minutes_between(F.col("first_update"), F.col("last_update"))
    return paired.withColumns(
        {
            "cust_ia": F.when(
                (F.col("check_in") != 0) & F.col("_i.cust_ia").isNull(), since_first
            ).otherwise(F.col("_i.cust_ia")),
            "service_ia": F.when(
                (F.col("check_out") != 0) & F.col("_o.service_ia").isNull(), since_first
            ).otherwise(F.col("_o.service_ia")),
        }
    ).drop("_ins", "_outs", "_i", "_o")


def moment_sums(moment) -> dict[str, Column]:
    """Of the moment's check-ins (check-outs): how many, how many have a gap, and
    the sum of the gaps."""
    over = lambda c: F.coalesce(F.sum(c).over(moment), F.lit(0))
    return {
        "ins": over((F.col("check_in") > 0).cast("long")),
        "ins_known": over(F.col("cust_ia").isNotNull().cast("long")),
        "in_minutes": over(F.col("cust_ia")),
        "outs": over((F.col("check_out") > 0).cast("long")),
        "outs_known": over(F.col("service_ia").isNotNull().cast("long")),
        "out_minutes": over(F.col("service_ia")),
    }


def weighted(first: Column) -> dict[str, Column]:
    """A row's part in the sums of its slot.

    Joining a moment's events to its rows on (number, last_update) would repeat a
    row once for each pair of a check-in and a check-out of the moment, or once for
    each of one kind if there is none of the other.  These weights stand for the
    repeats.  A first event without a predecessor counts from the station's first
    row (``first``).
    """
    a, b = F.greatest(F.lit(1), F.col("ins")), F.greatest(F.lit(1), F.col("outs"))
    since = cal.minutes_between(first, F.col("last_update"))
    no_in = F.when(F.col("check_in") > 0, F.col("ins") - F.col("ins_known")).otherwise(0)
    no_out = F.when(F.col("check_out") > 0, F.col("outs") - F.col("outs_known")).otherwise(0)
    times = lambda n: F.when(n > 0, n * since).otherwise(0.0)
    return {
        "w_diff": a * b * F.col("diff"),
        "w_in": a * b * F.col("check_in"),
        "w_out": a * b * F.col("check_out"),
        "n_cust": b * (F.col("ins_known") + no_in),
        "s_cust": b * (F.col("in_minutes") + times(no_in)),
        "n_service": a * (F.col("outs_known") + no_out),
        "s_service": a * (F.col("out_minutes") + times(no_out)),
    }


PARTS = ("w_diff", "w_in", "w_out", "n_cust", "s_cust", "n_service", "s_service")


def queue_panel(
    snapshots: DataFrame,
    order: str = CHRONOLOGICAL,
    tiebreak: Sequence[str] = TIEBREAK,
    distinct: bool = True,
) -> DataFrame:
    """10-minute panel with mean inter-arrival times.

    A moment is settled if it holds neither the slot's first row nor the first
    event of its kind of a name and address; its rows are summed at once.  The rows
    of other moments, a few per slot, travel with the summary, as an array, until
    the chain tells what they lack.
    """
    rows = with_known_events(inside(slots(snapshots, tiebreak, distinct)), tiebreak)
    change = F.col("change")
    rows = rows.withColumns({"diff": change.cast("long"), "check_in": check_in(change).cast("long"), "check_out": check_out(change).cast("long")})
    moment = W.partitionBy(*SLOT, "last_update")
    minutes = lambda seen: cal.minutes_between(F.col(seen), F.col("last_update"))
    rows = rows.withColumns(
        {
            "cust_ia": F.when(change > 0, minutes("in_seen")),
            "service_ia": F.when(change < 0, minutes("out_seen")),
            "open": F.max(
                (F.col("seat") == 1) | ((change > 0) & F.col("in_seen").isNull()) | ((change < 0) & F.col("out_seen").isNull())
            ).over(moment),
        }
    ).withColumns(moment_sums(moment))
    settled = {k: F.when(~F.col("open"), v) for k, v in weighted(F.lit(None).cast("timestamp_ntz")).items()}
    held = F.struct("last_update", "seat", "change", "in_seen", "out_seen")
    rolled = rows.groupBy(*PLACE).agg(
        F.min("bike_stands").alias("bike_stands"),
        F.max_by("available_bike_stands", "seat").alias("available_stands"),
        *[F.coalesce(F.sum(v), F.lit(0)).alias(f"settled_{k}") for k, v in settled.items()],
        F.collect_list(F.when(F.col("open"), held)).alias("held"),
        *summary_columns(),
    )
    rolled = chained(rolled, order)
    late = rolled.select("*", F.inline_outer("held")).drop("held")
    diff = F.coalesce("change", F.when(F.col("seat") == 1, F.col("entry"))).cast("long")
    late = late.withColumn("diff", diff)
    late = late.withColumns({"check_in": check_in(F.col("diff")), "check_out": check_out(F.col("diff"))})
    late = late.withColumns(
        {
            "cust_ia": gap(F.col("check_in") > 0, "in_seen", "opened_in", "in_before"),
            "service_ia": gap(F.col("check_out") > 0, "out_seen", "opened_out", "out_before"),
        }
    ).withColumns(moment_sums(moment))
    late = late.withColumns(weighted(F.col("first_update")))
    total = {k: F.coalesce(F.sum(k), F.lit(0)) + F.max(f"settled_{k}") for k in PARTS}
    panel = late.groupBy(*PLACE).agg(
        F.min("bike_stands").alias("bike_stands"),
        F.min("available_stands").alias("available_stands"),
        *[v.alias(k) for k, v in total.items()],
    )
    slot = F.col("slot")
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    return panel.select(
        *PLACE,
        "bike_stands",
        "available_stands",
        F.col("w_diff").cast("long").alias("prev_period_diff"),
        F.col("w_in").cast("long").alias("check_in"),
        mean("s_cust", "n_cust").alias("cust_ia"),
        F.col("w_out").cast("long").alias("check_out"),
        mean("s_service", "n_service").alias("service_ia"),
        cal.time_text(slot).alias("time"),
        cal.hour_of(slot).alias("h"),
        cal.minute_of(slot).alias("m"),
    )


def mean_gaps(queue: DataFrame) -> DataFrame:
    return queue.groupBy("number", "name").agg(
        F.avg("cust_ia").alias("cust_ia"), F.avg("service_ia").alias("service_ia")
    )


def worst_gaps(queue: DataFrame) -> DataFrame:
    """The slots in which a station reached its longest check-in gap; a station
    without any gap gives one row without a slot.

    The rows of a station (at most 144 a day) lie together already, so its peak is
    a window over them.
    """
    station = W.partitionBy("number")
    rows = queue.withColumns(
        {
            "_peak": F.max("cust_ia").over(station),
            "max_service_ia": F.max("service_ia").over(station),
            "_place": F.row_number().over(station.orderBy("date", "slot", "name", "address")),
        }
    ).where("cust_ia = _peak OR (_peak IS NULL AND _place = 1)")
    rest = [c for c in queue.columns if c not in ("number", "cust_ia")]
    known = F.col("_peak").isNotNull()
    return rows.select("number", "cust_ia", "max_service_ia", *[F.when(known, F.col(c)).alias(c) for c in rest])


def queue_parameters(queue: DataFrame) -> DataFrame:
    """Capacity, stock, mean times and their ratio per station, weekday and hour.

    ``rho`` is the ratio of the mean inter-arrival times, not of rates.
    """
    first = F.struct("date", "m", "address")
    return (
        queue.groupBy("number", "name", cal.weekday_name(F.col("date")).alias("weekday"), "h")
        .agg(
            F.min_by("bike_stands", first).alias("capacity"),
            F.min_by("available_stands", first).alias("start"),
            F.avg("cust_ia").alias("lam"),
            F.avg("service_ia").alias("mu"),
        )
        .withColumn("rho", F.try_divide(F.col("lam"), F.col("mu")))
    )


def with_probabilities(params: DataFrame, target: float = TARGET, t: float = 1.0) -> DataFrame:
    c, s = F.col("capacity").cast("double"), F.col("start").cast("double")
    rho, lam, mu = F.col("rho"), F.col("lam"), F.col("mu")
    return spread(params, "number", "name", "weekday", "h").withColumns(
        {
            "steady": queueing.steady_state(target, c, rho),
            "probability": queueing.transition(c, s, target, rho, lam, mu, t),
        }
    )


def with_bounds(params: DataFrame, t_start: float = T_START, t_end: float = T_END) -> DataFrame:
    c, rho, lam, mu = F.col("capacity").cast("double"), F.col("rho"), F.col("lam"), F.col("mu")
    return spread(params, "number", "name", "weekday", "h").withColumns(
        {
            "s_min": queueing.lower_bound(c, rho, lam, mu, t_start, t_end),
            "s_max": queueing.upper_bound(c, rho, lam, mu, t_start, t_end),
        }
    )
