"""Exploration of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockflow.plans import explore, streaks
from dockflow.plans import panel as panels
from registry import fixture as fx
from registry.fixture import ints, plain, reals, select

ACTIVE = 1500


def _season(s, d):
    rows = panels.study_period(fx.order_panel(s, d), "1996-03-01", "1999-09-30")
    return plain(explore.season_activity(rows))


def _melt(s, d):
    rows = fx.order_panel(s, d)
    return plain(explore.melt(rows, ["number", "date", "weekday"]))


QUERIES = {
    "top_checkin_ties": lambda s, d: plain(explore.top_by_check_in(fx.panel(s, d))),
    "top_checkout_ties": lambda s, d: plain(explore.top_by_check_out(fx.panel(s, d))),
    "top_activity_ties": lambda s, d: plain(explore.top_by_activity(fx.panel(s, d), 10)),
    "bottom_activity_ties": lambda s, d: plain(explore.top_by_activity(fx.panel(s, d), -10)),
    "top_small_values_ties": lambda s, d: plain(
        explore.top_n(fx.panel(s, d).groupBy("number", "slot").agg(F.max("check_in").alias("most")), 10, "most")
    ),
    "station_totals": lambda s, d: plain(explore.totals(fx.panel(s, d), ["number"])),
    "top_rows_semi": lambda s, d: plain(_semi(s, d)),
    "weekday_means": lambda s, d: plain(explore.weekday_means(fx.panel(s, d))),
    "weekday_activity": lambda s, d: plain(explore.weekday_activity(fx.panel(s, d))),
    "weekday_box": lambda s, d: plain(explore.weekday_boxes(fx.panel(s, d))),
    "daypart_usage": lambda s, d: plain(explore.day_part_usage(fx.panel(s, d))),
    "hourly_mean_sd": lambda s, d: plain(explore.hourly_spread(fx.panel(s, d), fx.STATION)),
    "slot_variability": lambda s, d: plain(explore.slot_variability(fx.panel(s, d))),
    "slot_variability_top_per_station": lambda s, d: plain(explore.most_variable_slots(fx.panel(s, d))),
    "ordered_weekdays": lambda s, d: plain(explore.ordered_weekdays(fx.panel(s, d))),
    "between_times": lambda s, d: plain(explore.between_times(fx.panel(s, d), "7:20", "10:00:00")),
    "monday_by_hour": lambda s, d: plain(explore.weekday_profile(fx.panel(s, d), "Mon", "hour")),
    "monday_by_slot": lambda s, d: plain(explore.weekday_profile(fx.panel(s, d), "Mon", "slot")),
    "pair_curve": lambda s, d: plain(explore.compare_stations(fx.panel(s, d), fx.PAIR, False)),
    "pair_curve_weekday": lambda s, d: plain(explore.compare_stations(fx.panel(s, d), fx.PAIR, True)),
    "weekend_early": lambda s, d: plain(explore.weekend_early(fx.panel(s, d), fx.PAIR)),
    "active_station_labels": lambda s, d: plain(
        explore.busiest_and_quietest(fx.panel(s, d), fx.stations(s, d), 10, ACTIVE)
    ),
    "season_activity": _season,
    "melt_activity": _melt,
    "distinct_stations": lambda s, d: plain(explore.distinct_stations(fx.panel(s, d))),
    "slot_dimension": lambda s, d: plain(explore.slot_dimension(fx.panel(s, d))),
    "running_sum_reset": lambda s, d: plain(
        streaks.running_flows(fx.panel(s, d)).select(
            "number", "name", "date", "slot", "check_in", "run_in", "check_out", "run_out"
        )
    ),
}


def _semi(s, d):
    rows = fx.panel(s, d)
    return explore.rows_of(rows, explore.top_by_check_in(rows), "name")


def _top(by: str, value: str, name: str, order: str) -> str:
    return select(
        [fx.PANEL],
        f"SELECT {by}, {name} FROM (SELECT *, rank() OVER (ORDER BY {name} {order}) AS rk FROM ("
        f"SELECT {by}, CAST(sum({value}) AS BIGINT) AS {name} FROM panel GROUP BY {by})) WHERE rk <= 10",
    )


BOX = """
vals AS (
  SELECT weekday, 'avg_cin' AS measure, avg(check_in) AS v FROM panel GROUP BY number, name, weekday
  UNION ALL SELECT weekday, 'avg_cout', avg(check_out) FROM panel GROUP BY number, name, weekday
  UNION ALL SELECT weekday, 'tot_act', CAST(sum(check_in + check_out) AS DOUBLE) FROM panel GROUP BY number, name, weekday),
q AS (SELECT weekday, measure, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM vals GROUP BY weekday, measure)"""

VARIABILITY = """
vari AS (
  SELECT number, name, time, slot, stddev_samp(check_in) AS sd_in, avg(check_in) AS mean_in, max(check_in) AS max_in,
         min(check_in) AS min_in, stddev_samp(check_out) AS sd_out, avg(check_out) AS mean_out,
         max(check_out) AS max_out, min(check_out) AS min_out
  FROM panel GROUP BY number, name, time, slot)"""
VARIABILITY_OUT = (
    "CAST(number AS BIGINT) AS number, name, time, CAST(slot AS BIGINT) AS slot, "
    + reals("sd_in", "mean_in", "sd_out", "mean_out") + ", " + ints("max_in", "min_in", "max_out", "min_out")
)
SEASON_CASE = (
    "CASE WHEN month(date) IN (11, 12, 1) THEN 'Winter' WHEN month(date) IN (2, 3, 4) THEN 'Spring' "
    "WHEN month(date) IN (5, 6, 7) THEN 'Summer' ELSE 'Autumn' END"
)


def _profile(grain: str, unit: str) -> str:
    return select(
        [fx.PANEL],
        f"SELECT CAST({unit} AS BIGINT) AS {grain}, CAST(sum(check_in) AS BIGINT) AS check_in, "
        "CAST(sum(check_out) AS BIGINT) AS check_out, CAST(sum(check_in + check_out) AS BIGINT) AS activity "
        "FROM panel WHERE weekday = 'Mon' GROUP BY 1",
    )


SQL = {
    "top_checkin_ties": _top("name", "check_in", "tot_check_in", "DESC"),
    "top_checkout_ties": _top("name", "check_out", "tot_check_out", "DESC"),
    "top_activity_ties": _top("address", "check_in + check_out", "tot_act", "DESC"),
    "bottom_activity_ties": _top("address", "check_in + check_out", "tot_act", "ASC"),
    "top_small_values_ties": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, CAST(slot AS BIGINT) AS slot, most FROM ("
        "SELECT *, rank() OVER (ORDER BY most DESC) AS rk FROM ("
        "SELECT number, slot, max(check_in) AS most FROM panel GROUP BY number, slot)) WHERE rk <= 10",
    ),
    "station_totals": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, CAST(sum(check_in) AS BIGINT) AS tot_check_in, "
        "CAST(sum(check_out) AS BIGINT) AS tot_check_out, CAST(sum(check_in + check_out) AS BIGINT) AS tot_act "
        "FROM panel GROUP BY number",
    ),
    "top_rows_semi": select(
        [fx.PANEL],
        f"SELECT {fx.PANEL_OUT} FROM panel WHERE name IN (SELECT name FROM (SELECT name, "
        "rank() OVER (ORDER BY sum(check_in) DESC) AS rk FROM panel GROUP BY name) WHERE rk <= 10)",
    ),
    "weekday_means": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, name, weekday, round(avg(check_in) + 1.3e-9, 6) + 0.0 AS avg_cin, "
        "round(avg(check_out) + 1.3e-9, 6) + 0.0 AS avg_cout FROM panel GROUP BY number, name, weekday",
    ),
    "weekday_activity": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, name, weekday, CAST(sum(check_in + check_out) AS BIGINT) AS tot_act "
        "FROM panel GROUP BY number, name, weekday",
    ),
    "weekday_box": select(
        [fx.PANEL, BOX],
        "SELECT weekday, round(q1 + 1.3e-9, 6) + 0.0 AS q1, round(median + 1.3e-9, 6) + 0.0 AS median, round(q3 + 1.3e-9, 6) + 0.0 AS q3, "
        "round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) + 1.3e-9, 6) + 0.0 AS low_whisker, "
        "round(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) + 1.3e-9, 6) + 0.0 AS high_whisker, "
        "count(CASE WHEN NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) THEN 1 END) AS outliers, measure "
        "FROM vals JOIN q USING (weekday, measure) GROUP BY weekday, measure, q1, median, q3",
    ),
    "daypart_usage": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, name, CASE WHEN slot // 60 BETWEEN 5 AND 11 THEN 'Morning' "
        "WHEN slot // 60 BETWEEN 12 AND 18 THEN 'Afternoon' WHEN slot // 60 >= 19 THEN 'Night' ELSE 'Late night' END AS period, "
        "weekday, CAST(sum(check_in) AS BIGINT) AS tot_in, CAST(sum(check_out) AS BIGINT) AS tot_out, "
        "round(avg(check_in) + 1.3e-9, 6) + 0.0 AS avg_in, round(avg(check_out) + 1.3e-9, 6) + 0.0 AS avg_out FROM panel GROUP BY 1, 2, 3, 4",
    ),
    "hourly_mean_sd": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, CAST(slot // 60 AS BIGINT) AS t_hour, round(avg(check_in) + 1.3e-9, 6) + 0.0 AS mean_in, "
        "round(stddev_samp(check_in) + 1.3e-9, 6) + 0.0 AS sd_in, round(avg(check_out) + 1.3e-9, 6) + 0.0 AS mean_out, "
        "round(stddev_samp(check_out) + 1.3e-9, 6) + 0.0 AS sd_out FROM panel WHERE number = 5 GROUP BY 1, 2",
    ),
    "slot_variability": select([fx.PANEL, VARIABILITY], f"SELECT {VARIABILITY_OUT} FROM vari"),
    "slot_variability_top_per_station": select(
        [fx.PANEL, VARIABILITY],
        f"SELECT {VARIABILITY_OUT} FROM (SELECT *, rank() OVER (PARTITION BY number, name ORDER BY sd_in DESC) AS rk "
        "FROM vari WHERE slot // 60 >= 5 AND sd_in IS NOT NULL) WHERE rk <= 10",
    ),
    "ordered_weekdays": select(
        [fx.PANEL],
        "SELECT weekday, season, CAST(sum(check_in + check_out) AS BIGINT) AS tot_act, CAST(isodow AS BIGINT) - 1 AS weekday_place, "
        "CAST(list_position(['Winter', 'Spring', 'Summer', 'Autumn'], season) AS BIGINT) - 1 AS season_place FROM ("
        "SELECT *, isodow(date) AS isodow, CASE WHEN month(date) IN (11, 12, 1) THEN 'Winter' WHEN month(date) IN (2, 3, 4) THEN 'Spring' "
        "WHEN month(date) IN (5, 6, 7) THEN 'Summer' ELSE 'Autumn' END AS season FROM panel) GROUP BY weekday, season, isodow",
    ),
    "between_times": select([fx.PANEL], f"SELECT {fx.PANEL_OUT} FROM panel WHERE slot >= 440 AND slot < 600"),
    "monday_by_hour": _profile("hour", "slot // 60"),
    "monday_by_slot": _profile("slot", "slot"),
    "pair_curve": select(
        [fx.PANEL],
        "SELECT name, CAST(slot AS BIGINT) AS slot, round(avg(check_in) + 1.3e-9, 6) + 0.0 AS mean_in, round(avg(check_out) + 1.3e-9, 6) + 0.0 AS mean_out "
        "FROM panel WHERE number = 5 OR number = 8 GROUP BY name, slot",
    ),
    "pair_curve_weekday": select(
        [fx.PANEL],
        "SELECT name, CAST(slot AS BIGINT) AS slot, weekday, round(avg(check_in) + 1.3e-9, 6) + 0.0 AS mean_in, "
        "round(avg(check_out) + 1.3e-9, 6) + 0.0 AS mean_out FROM panel WHERE number = 5 OR number = 8 GROUP BY name, slot, weekday",
    ),
    "weekend_early": select(
        [fx.PANEL],
        "SELECT name, CAST(slot AS BIGINT) AS slot, weekday, max(check_in) AS max_in, max(check_out) AS max_out, "
        "round(avg(check_in) + 1.3e-9, 6) + 0.0 AS mean_in, round(avg(check_out) + 1.3e-9, 6) + 0.0 AS mean_out FROM panel "
        "WHERE number IN (5, 8) AND weekday IN ('Sat', 'Sun') AND slot // 60 > 5 AND slot // 60 < 10 "
        "GROUP BY name, slot, weekday",
    ),
    "active_station_labels": select(
        [fx.PANEL, fx.GEO, """
act AS (SELECT address, CAST(sum(check_in + check_out) AS BIGINT) AS tot_act FROM panel GROUP BY address),
picked AS (SELECT address, tot_act FROM (SELECT *, rank() OVER (ORDER BY tot_act DESC) AS hi,
           rank() OVER (ORDER BY tot_act) AS lo FROM act) WHERE hi <= 10 OR lo <= 10)"""],
        "SELECT CAST(x.number AS BIGINT) AS number, x.address, x.tot_act, CASE WHEN x.tot_act > 1500 THEN 'Most Active' "
        "ELSE 'Least Active' END AS rank, g.name, round(g.latitude + 1.3e-9, 6) + 0.0 AS latitude, round(g.longitude + 1.3e-9, 6) + 0.0 AS longitude "
        "FROM (SELECT DISTINCT p.number, p.address, k.tot_act FROM panel p JOIN picked k ON p.address = k.address) x "
        "LEFT JOIN geo g ON x.number = g.number AND x.address = g.address",
    ),
    "season_activity": select(
        [fx.ORDER_PANEL],
        f"SELECT weekday, {SEASON_CASE} AS season, CAST(sum(check_in + check_out) AS BIGINT) AS activity FROM order_panel "
        "WHERE date >= DATE '1996-03-01' AND date <= DATE '1999-09-30' GROUP BY 1, 2",
    ),
    "melt_activity": select(
        [fx.ORDER_PANEL],
        "SELECT CAST(number AS BIGINT) AS number, CAST(date AS VARCHAR) AS date, weekday, 'check_in' AS variable, "
        "check_in AS value FROM order_panel UNION ALL SELECT CAST(number AS BIGINT), CAST(date AS VARCHAR), weekday, "
        "'check_out', check_out FROM order_panel",
    ),
    "distinct_stations": select([fx.PANEL], "SELECT DISTINCT CAST(number AS BIGINT) AS number, name FROM panel"),
    "slot_dimension": select(
        [fx.PANEL],
        "SELECT DISTINCT time, CAST(slot AS BIGINT) AS slot, CASE WHEN slot % 60 = 0 THEN "
        "regexp_extract(time, '\\d+:\\d+') END AS label FROM panel",
    ),
    "running_sum_reset": select(
        [fx.PANEL, """
isl AS (SELECT *, sum(CASE WHEN check_in = 0 THEN 1 ELSE 0 END) OVER w AS i_in,
               sum(CASE WHEN check_out = 0 THEN 1 ELSE 0 END) OVER w AS i_out FROM panel
        WINDOW w AS (PARTITION BY number ORDER BY date, slot, name, address))"""],
        "SELECT CAST(number AS BIGINT) AS number, name, CAST(date AS VARCHAR) AS date, CAST(slot AS BIGINT) AS slot, "
        "check_in, CAST(sum(check_in) OVER (PARTITION BY number, i_in ORDER BY date, slot, name, address) AS BIGINT) AS run_in, "
        "check_out, CAST(sum(check_out) OVER (PARTITION BY number, i_out ORDER BY date, slot, name, address) AS BIGINT) AS run_out "
        "FROM isl",
    ),
}
