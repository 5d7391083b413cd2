"""Inter-arrival times and queueing bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockflow.functions import queueing
from dockflow.plans import panel as panels
from dockflow.plans import queue
from registry import fixture as fx
from registry.fixture import plain, reals, select

START = "2024-01-08"
TARGET = 30


def _queue(s, d):
    return queue.queue_panel(fx.snapshots(s, d), tiebreak=fx.TIEBREAK)


def _rows(s, d):
    return queue.with_interarrival(fx.snapshots(s, d), tiebreak=fx.TIEBREAK)


def _params(s, d):
    return queue.queue_parameters(panels.from_date(_queue(s, d), START))


def _interarrival(s, d):
    rows = _rows(s, d).where((F.col("check_in") != 0) | (F.col("check_out") != 0))
    return plain(rows.select("number", "name", "event_id", "last_update", "cust_ia", "service_ia"))


def _closed(s, d):
    rows = queue.joined_interarrival(_rows(s, d))
    return plain(rows.select("number", "name", "event_id", "check_in", "check_out", "cust_ia", "service_ia"))


def _probabilities(s, d):
    rows = queue.with_probabilities(_params(s, d), TARGET, 1.0)
    return plain(rows.select("number", "name", "weekday", "h", "steady", "probability"))


def _terms(s, d):
    """The single terms of the formula for the fifth mode."""
    c, start = F.col("capacity").cast("double"), F.col("start").cast("double")
    rho, lam, mu = F.col("rho"), F.col("lam"), F.col("mu")
    rate = queueing.decay_rate(5, lam, mu, c)
    rows = _params(s, d).select(
        "number", "name", "weekday", "h", rate.alias("rate"),
        queueing.mode_weight(5, mu, rate, start, c, rho, TARGET).alias("weight"),
        queueing.mean_transition(c, start, TARGET, rho, lam, mu, queue.T_START, queue.T_END).alias("g"))
    return plain(rows)


def _bounds(s, d):
    rows = queue.with_bounds(_params(s, d))
    return plain(rows.select(
        "number", "name", "weekday", "h",
        F.col("s_min").cast("double").alias("s_min"), F.col("s_max").cast("double").alias("s_max")))


QUERIES = {
    "interarrival": _interarrival,
    "interarrival_closed": _closed,
    "queue_panel": lambda s, d: plain(_queue(s, d)),
    "queue_panel_from_date": lambda s, d: plain(panels.from_date(_queue(s, d), START)),
    "queue_mean_gaps": lambda s, d: plain(queue.mean_gaps(_queue(s, d))),
    "queue_worst_gap": lambda s, d: plain(queue.worst_gaps(_queue(s, d))),
    "queue_params": lambda s, d: plain(_params(s, d)),
    "queue_prob": _probabilities,
    "queue_terms": _terms,
    "queue_bounds": _bounds,
}

IA = """
in_ev AS (SELECT number, event_id, last_update, date_diff('microsecond', lag(last_update) OVER (
            PARTITION BY number, name, address ORDER BY last_update, event_id), last_update) / 60000000.0 AS cust_ia
          FROM changes WHERE diff > 0),
out_ev AS (SELECT number, event_id, last_update, date_diff('microsecond', lag(last_update) OVER (
            PARTITION BY number, name, address ORDER BY last_update, event_id), last_update) / 60000000.0 AS service_ia
          FROM changes WHERE diff < 0),
closed AS (
  SELECT c.*, CASE WHEN c.diff > 0 AND i.cust_ia IS NULL
                   THEN date_diff('microsecond', min(c.last_update) OVER (PARTITION BY c.number), c.last_update) / 60000000.0
                   ELSE i.cust_ia END AS cust_ia,
         CASE WHEN c.diff < 0 AND o.service_ia IS NULL
                   THEN date_diff('microsecond', min(c.last_update) OVER (PARTITION BY c.number), c.last_update) / 60000000.0
                   ELSE o.service_ia END AS service_ia
  FROM changes c LEFT JOIN in_ev i ON c.number = i.number AND c.last_update = i.last_update
                 LEFT JOIN out_ev o ON c.number = o.number AND c.last_update = o.last_update),
queue AS (
  SELECT number, name, address, date, slot, min(bike_stands) AS bike_stands,
         arg_max(available_bike_stands, last_update) AS available_stands, CAST(sum(diff) AS BIGINT) AS prev_period_diff,
         CAST(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END) AS BIGINT) AS check_in, avg(cust_ia) AS cust_ia,
         CAST(sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END) AS BIGINT) AS check_out, avg(service_ia) AS service_ia,
         concat(CAST(slot // 60 AS VARCHAR), ':', lpad(CAST(slot % 60 AS VARCHAR), 2, '0'), ':00') AS time,
         slot // 60 AS h, slot % 60 AS m
  FROM closed GROUP BY number, name, address, date, slot)"""

QUEUE_OUT = (
    "CAST(number AS BIGINT) AS number, name, address, CAST(date AS VARCHAR) AS date, CAST(slot AS BIGINT) AS slot, "
    "CAST(bike_stands AS BIGINT) AS bike_stands, CAST(available_stands AS BIGINT) AS available_stands, prev_period_diff, "
    "check_in, round(cust_ia + 1.3e-9, 6) + 0.0 AS cust_ia, check_out, round(service_ia + 1.3e-9, 6) + 0.0 AS service_ia, time, "
    "CAST(h AS BIGINT) AS h, CAST(m AS BIGINT) AS m"
)

PARAMS = """
params AS (
  SELECT *, CASE WHEN mu = 0 THEN NULL ELSE lam / mu END AS rho FROM (
    SELECT number, name, strftime(date, '%a') AS weekday, h, arg_min(bike_stands, date + to_minutes(m)) AS capacity,
           arg_min(available_stands, date + to_minutes(m)) AS start, avg(cust_ia) AS lam, avg(service_ia) AS mu
    FROM queue WHERE date >= DATE '2024-01-08' GROUP BY number, name, 3, h))"""


RATE = "(lam + mu - 2.0 * sqrt(lam * mu) * cos({m} * pi() / (capacity + 1)))"


def _wave(m: str, level: str) -> str:
    step = "pi() / (capacity + 1)"
    return f"(sin({m} * {level} * {step}) - sqrt(rho) * sin({m} * ({level} + 1) * {step}))"


def _p(start: str, target: str, t: str) -> str:
    """Transition probability of one row of params as SQL."""
    rate = RATE.format(m="m")
    term = f"mu / {rate} * {_wave('m', start)} * {_wave('m', target)} * exp(-{rate} * {t}) / {rate}"
    total = f"list_sum(list_transform(range(1, CAST(capacity AS BIGINT) + 1), lambda m: {term}))"
    steady = (
        f"(CASE WHEN rho = 1 THEN 1.0 / (capacity + 1) "
        f"ELSE (1 - rho) / (1 - pow(rho, capacity + 1)) * pow(rho, {target}) END)"
    )
    return f"({steady} * {t} - 2.0 * pow(rho, ({target} - {start}) / 2.0) / (capacity + 1) * {total})"


def _good(target: str) -> str:
    g = f"(({_p('s', target, '10.0')} - {_p('s', target, '6.0')}) / 10.0)"
    return f"list_filter(range(0, CAST(capacity AS BIGINT) + 1), lambda s: (1 - {g}) >= 0.95)"


KEY = "CAST(number AS BIGINT) AS number, name, weekday, CAST(h AS BIGINT) AS h"

SQL = {
    "interarrival": select(
        [fx.CHANGES, IA],
        "SELECT CAST(c.number AS BIGINT) AS number, c.name, c.event_id, epoch_us(c.last_update) AS last_update, "
        "round(i.cust_ia + 1.3e-9, 6) + 0.0 AS cust_ia, round(o.service_ia + 1.3e-9, 6) + 0.0 AS service_ia FROM changes c "
        "LEFT JOIN in_ev i ON c.event_id = i.event_id LEFT JOIN out_ev o ON c.event_id = o.event_id WHERE c.diff <> 0",
    ),
    "interarrival_closed": select(
        [fx.CHANGES, IA],
        "SELECT CAST(number AS BIGINT) AS number, name, event_id, CAST(CASE WHEN diff > 0 THEN diff ELSE 0 END AS BIGINT) AS check_in, "
        "CAST(CASE WHEN diff < 0 THEN -diff ELSE 0 END AS BIGINT) AS check_out, round(cust_ia + 1.3e-9, 6) + 0.0 AS cust_ia, "
        "round(service_ia + 1.3e-9, 6) + 0.0 AS service_ia FROM closed",
    ),
    "queue_panel": select([fx.CHANGES, IA], f"SELECT {QUEUE_OUT} FROM queue"),
    "queue_panel_from_date": select(
        [fx.CHANGES, IA], f"SELECT {QUEUE_OUT} FROM queue WHERE date >= DATE '2024-01-08'"
    ),
    "queue_mean_gaps": select(
        [fx.CHANGES, IA],
        "SELECT CAST(number AS BIGINT) AS number, name, round(avg(cust_ia) + 1.3e-9, 6) + 0.0 AS cust_ia, "
        "round(avg(service_ia) + 1.3e-9, 6) + 0.0 AS service_ia FROM queue GROUP BY number, name",
    ),
    "queue_worst_gap": select(
        [fx.CHANGES, IA, """
peaks AS (SELECT number, max(cust_ia) AS peak, max(service_ia) AS max_service_ia FROM queue GROUP BY number)"""],
        f"SELECT {QUEUE_OUT.replace('CAST(number AS BIGINT) AS number', 'CAST(q.number AS BIGINT) AS number')}, "
        "round(max_service_ia + 1.3e-9, 6) + 0.0 AS max_service_ia FROM peaks k LEFT JOIN queue q ON k.number = q.number AND k.peak = q.cust_ia",
    ),
    "queue_params": select(
        [fx.CHANGES, IA, PARAMS],
        f"SELECT {KEY}, CAST(capacity AS BIGINT) AS capacity, CAST(start AS BIGINT) AS start, {reals('lam', 'mu', 'rho')} FROM params",
    ),
    "queue_prob": select(
        [fx.CHANGES, IA, PARAMS],
        f"SELECT {KEY}, round(CASE WHEN rho = 1 THEN 1.0 / (capacity + 1) ELSE (1 - rho) / (1 - pow(rho, capacity + 1)) * "
        f"pow(rho, 30.0) END + 1.3e-9, 6) + 0.0 AS steady, round({_p('start', '30.0', '1.0')} + 1.3e-9, 6) + 0.0 AS probability FROM params",
    ),
    "queue_terms": select(
        [fx.CHANGES, IA, PARAMS],
        f"SELECT {KEY}, round({RATE.format(m=5)} + 1.3e-9, 6) + 0.0 AS rate, "
        f"round(mu / {RATE.format(m=5)} * {_wave('5', 'start')} * {_wave('5', '30.0')} + 1.3e-9, 6) + 0.0 AS weight, "
        f"round(({_p('start', '30.0', '10.0')} - {_p('start', '30.0', '6.0')}) / 10.0 + 1.3e-9, 6) + 0.0 AS g FROM params",
    ),
    "queue_bounds": select(
        [fx.CHANGES, IA, PARAMS],
        f"SELECT {KEY}, CAST(CASE WHEN rho IS NOT NULL THEN list_min({_good('0.0')}) END AS DOUBLE) AS s_min, "
        f"CAST(CASE WHEN rho IS NOT NULL THEN coalesce(list_max({_good('capacity')}), -1) END AS DOUBLE) AS s_max FROM params",
    ),
}
