"""Daily profiles, gap fill, scaling and station clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockflow.plans import clusters, explore, profiles
from dockflow.schemas import DAY_SLOTS
from dockflow.session import shared_dir
from dockflow.sources import tables
from registry import fixture as fx
from registry.fixture import plain, reals, select

FLOWS = ["check_in", "check_out", "available_stands"]


def current(s, d):
    """Panel without the outdated station name."""
    return profiles.without_names(fx.panel(s, d), [fx.OLD_NAME])


def assigned(s, d):
    return clusters.nearest_centre(current(s, d), fx.centres(s))


def _csv(s, d):
    path = shared_dir(s)
    tables.write_cluster_csv(assigned(s, d), path)
    return plain(tables.read_cluster_csv(s, path))


def _kmeans(s, d, **subset):
    points = clusters.profile_points(current(s, d), **subset)
    model = clusters.fit_kmeans(points)
    slots = profiles.present_slots(clusters.subset(current(s, d), **subset))
    return plain(clusters.centre_curves(clusters.centres_frame(s, model, slots)))


def _station(s, d):
    return fx.panel(s, d).where(F.col("number") == fx.STATION)


def _flow_groups(s, d):
    points = clusters.flow_points(_station(s, d))
    rows = clusters.fit_kmeans(points).transform(points)
    return plain(clusters.with_cluster_slot_means(rows).select(
        "number", "date", "slot", "cluster", "cluster_mean_in", "cluster_mean_out"))


def _given_groups(s, d):
    """A given assignment in place of the fitted one, so the means are exact."""
    part = F.col("check_in") % 4
    return fx.panel(s, d).withColumn("cluster", part.cast("int"))


# The numbers of groups that the cost curves go through.
PROFILE_KS = list(range(2, 11))
FLOW_KS = list(range(2, 16))


def _elbow(s, d, **subset):
    points = clusters.profile_points(current(s, d), **subset)
    return plain(clusters.elbow_frame(s, points, PROFILE_KS))


def _elbow_facts(s, d):
    """Each cost lies under the spread of one group."""
    flows = _station(s, d)
    costs = clusters.elbow_frame(s, clusters.flow_points(flows), FLOW_KS)
    total = clusters.total_spread(flows, ["check_in", "check_out"]).select("wss").scalar()
    return costs.select(F.col("k").cast("bigint").alias("k"), ((F.col("wss") >= 0) & (F.col("wss") < total)).alias("under_total"))


def _kmeans_facts(s, d):
    """Per fit: rows that got a group, and whether all groups are in 0..k-1."""
    out = None
    for name, points in (
        ("profiles", clusters.profile_points(current(s, d))),
        ("weekdays", clusters.profile_points(current(s, d), weekdays=profiles.WEEKDAY_SET)),
        ("flows", clusters.flow_points(_station(s, d))),
    ):
        rows = clusters.fit_kmeans(points).transform(points)
        facts = rows.agg(
            F.count("cluster").alias("assigned"), F.min(F.col("cluster").between(0, clusters.K - 1)).alias("in_range")
        ).select(F.lit(name).alias("fit"), "assigned", "in_range")
        out = facts if out is None else out.unionByName(facts)
    return out


def _series(s, d):
    """The fits: name, points and the numbers of groups of the cost curve."""
    rows = current(s, d)
    subsets = {
        "profiles": {}, "weekdays": {"weekdays": profiles.WEEKDAY_SET}, "weekend": {"weekdays": profiles.WEEKEND_SET},
        "top10": {"top": 10}, "bottom10": {"top": -10},
    }
    for name, subset in subsets.items():
        yield name, clusters.profile_points(rows, **subset), PROFILE_KS
    yield "flows", clusters.flow_points(_station(s, d)), FLOW_KS


def _kmeans_fit_facts(s, d):
    """All six fits, held against their own published centres: no row has a nearer
    centre, each centre is the mean of its rows, within + between is the total."""

    def facts():
        for name, points, _ in _series(s, d):
            cached = points.select("features").persist()
            model = clusters.fit_kmeans(cached)
            row = clusters.fit_facts(model.transform(cached), [c.tolist() for c in model.clusterCenters()]).first()
            cached.unpersist()
            yield name, row["rows"], row["groups"], row["misplaced"], row["shifted"], round(row["within"] + row["between"], 3)

    return s.createDataFrame(list(facts()), "fit string, rows long, groups long, misplaced long, shifted long, total double")


def ends_of(ks):
    """First, middle and last of the numbers of groups."""
    return [ks[0], ks[len(ks) // 2], ks[-1]]


def _elbow_fit_facts(s, d):
    """All six cost curves, at both ends and in the middle: each cost is the within
    sum recomputed from the centres, and lies under the total."""

    def facts():
        for name, points, ks in _series(s, d):
            cached = points.select("features").persist()
            for k in ends_of(ks):
                model, cost = clusters.fit_with_cost(cached, k)
                facts = clusters.fit_facts(model.transform(cached), [c.tolist() for c in model.clusterCenters()]).first()
                total = facts["within"] + facts["between"]
                yield name, k, facts["misplaced"], abs(cost - facts["within"]) <= 1e-6 * total, cost < total
            cached.unpersist()

    return s.createDataFrame(list(facts()), "series string, k long, misplaced long, cost_is_within boolean, under_total boolean")


QUERIES = {
    "profile_wide": lambda s, d: plain(profiles.wide_of(profiles.days(current(s, d)))),
    "profile_filled": lambda s, d: plain(profiles.filled(current(s, d))),
    "profile_filled_per_station": lambda s, d: plain(profiles.filled(current(s, d), False)),
    "profile_filled_weekdays": lambda s, d: plain(
        profiles.filled(profiles.on_weekdays(current(s, d), profiles.WEEKDAY_SET))
    ),
    "profile_filled_legacy_weekdays": lambda s, d: plain(
        profiles.filled(profiles.on_weekdays(current(s, d), profiles.LEGACY_WEEKDAY_SET))
    ),
    "profile_unpivot": lambda s, d: plain(
        profiles.long_from_wide(profiles.wide_of(profiles.days(current(s, d))))
    ),
    "station_profile": lambda s, d: plain(profiles.station_profile(current(s, d))),
    "column_spread": lambda s, d: plain(clusters.column_spread(_station(s, d), FLOWS)),
    "scaled_spread": lambda s, d: plain(clusters.column_spread(clusters.range_scaled(_station(s, d), FLOWS), FLOWS)),
    "range_scaled": lambda s, d: plain(
        clusters.range_scaled(_station(s, d), FLOWS).select("date", "slot", *FLOWS)
    ),
    "zscored": lambda s, d: plain(
        clusters.zscored(_station(s, d), FLOWS).select("date", "slot", *FLOWS)
    ),
    "elbow_k1": lambda s, d: plain(clusters.total_spread(_station(s, d), ["check_in", "check_out"])),
    "elbow_k1_profiles": lambda s, d: plain(clusters.total_spread_long(profiles.filled(current(s, d)))),
    "nearest_centroid": lambda s, d: plain(assigned(s, d)),
    "station_curves": lambda s, d: plain(clusters.station_curves(current(s, d), assigned(s, d))),
    "cluster_curves": lambda s, d: plain(clusters.cluster_curves(current(s, d), assigned(s, d))),
    "cluster_csv_roundtrip": _csv,
    "cluster_map_points": lambda s, d: plain(clusters.cluster_map(assigned(s, d), fx.stations(s, d))),
    "cluster_means": lambda s, d: plain(clusters.cluster_means(_given_groups(s, d), FLOWS)),
    "cluster_mean_attached": lambda s, d: plain(
        clusters.with_cluster_slot_means(_given_groups(s, d)).select(
            "number", "name", "date", "slot", "cluster", "cluster_mean_in", "cluster_mean_out"
        )
    ),
    "kmeans_profiles": lambda s, d: _kmeans(s, d),
    "kmeans_weekdays": lambda s, d: _kmeans(s, d, weekdays=profiles.WEEKDAY_SET),
    "kmeans_weekend": lambda s, d: _kmeans(s, d, weekdays=profiles.WEEKEND_SET),
    "kmeans_top10": lambda s, d: _kmeans(s, d, top=10),
    "kmeans_bottom10": lambda s, d: _kmeans(s, d, top=-10),
    "kmeans_flows": _flow_groups,
    "elbow_curve": lambda s, d: _elbow(s, d),
    "elbow_weekdays": lambda s, d: _elbow(s, d, weekdays=profiles.WEEKDAY_SET),
    "elbow_weekend": lambda s, d: _elbow(s, d, weekdays=profiles.WEEKEND_SET),
    "elbow_top10": lambda s, d: _elbow(s, d, top=10),
    "elbow_bottom10": lambda s, d: _elbow(s, d, top=-10),
    "elbow_flows": lambda s, d: plain(
        clusters.elbow_frame(s, clusters.flow_points(_station(s, d)), FLOW_KS)
    ),
    "elbow_facts": _elbow_facts,
    "kmeans_facts": _kmeans_facts,
    "kmeans_fit_facts": _kmeans_fit_facts,
    "elbow_fit_facts": _elbow_fit_facts,
}

CURRENT = "current AS (SELECT * FROM panel WHERE name <> 'STATION 0 OLD')"


def _filled(source: str, across: bool) -> str:
    part = "slot" if across else "slot, number"
    return f"""
days AS (SELECT DISTINCT number, date FROM {source}),
grid AS (SELECT d.number, d.date, CAST(x.slot AS INTEGER) AS slot, c.available_stands
         FROM days d CROSS JOIN (SELECT unnest(range(0, 1440, 10)) AS slot) x
         LEFT JOIN {source} c ON c.number = d.number AND c.date = d.date AND c.slot = x.slot),
filled AS (
  SELECT number, date, slot, coalesce(
    last_value(available_stands IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY number, date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(available_stands IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY number, date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS available_stands FROM grid)"""


FILLED_OUT = (
    "SELECT CAST(number AS BIGINT) AS number, CAST(date AS VARCHAR) AS date, CAST(slot AS BIGINT) AS slot, "
    "CAST(available_stands AS BIGINT) AS available_stands FROM filled"
)
WIDE_COLUMNS = ", ".join(
    f'CAST(max(CASE WHEN slot = {s} THEN available_stands END) AS BIGINT) AS "{profiles.slot_column(s)}"'
    for s in DAY_SLOTS
)
ONE = "one AS (SELECT * FROM panel WHERE number = 5)"
KEYED = [fx.PANEL, fx.CENTRES, fx.CLUSTERS]


def _scaled(expr: str) -> str:
    cols = ", ".join("round(" + expr.format(c=c) + f" + 1.3e-9, 6) + 0.0 AS {c}" for c in FLOWS)
    return f"SELECT CAST(date AS VARCHAR) AS date, CAST(slot AS BIGINT) AS slot, {cols} FROM one"


TOTALS = f"""
ranked AS (SELECT number, rank() OVER (ORDER BY act DESC) AS high, rank() OVER (ORDER BY act) AS low
           FROM (SELECT number, sum(check_in + check_out) AS act FROM current GROUP BY number)),
sources AS (
  SELECT 'profiles' AS fit, * FROM current
  UNION ALL SELECT 'weekdays', * FROM current WHERE weekday IN ('Mon', 'Tue', 'Wed', 'Thu')
  UNION ALL SELECT 'weekend', * FROM current WHERE weekday IN ('Fri', 'Sat', 'Sun')
  UNION ALL SELECT 'top10', * FROM current WHERE number IN (SELECT number FROM ranked WHERE high <= 10)
  UNION ALL SELECT 'bottom10', * FROM current WHERE number IN (SELECT number FROM ranked WHERE low <= 10)),
days AS (SELECT DISTINCT fit, number, date FROM sources),
grid AS (SELECT d.fit, d.number, d.date, x.slot, c.available_stands
         FROM days d CROSS JOIN (SELECT unnest(range(0, 1440, 10)) AS slot) x
         LEFT JOIN sources c ON c.fit = d.fit AND c.number = d.number AND c.date = d.date AND c.slot = x.slot),
filled AS (
  SELECT fit, slot, coalesce(
    last_value(available_stands IGNORE NULLS) OVER (PARTITION BY fit, slot ORDER BY number, date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(available_stands IGNORE NULLS) OVER (PARTITION BY fit, slot ORDER BY number, date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS available_stands FROM grid),
totals AS (
  SELECT fit, max(n) AS rows, round(sum((n - 1) * v), 3) AS total
  FROM (SELECT fit, slot, var_samp(available_stands) AS v, count(*) AS n FROM filled GROUP BY fit, slot) GROUP BY fit
  UNION ALL SELECT 'flows', count(*), round((count(*) - 1) * (var_samp(check_in) + var_samp(check_out)), 3) FROM one)"""

SQL = {
    "kmeans_fit_facts": select(
        [fx.PANEL, CURRENT, ONE, TOTALS],
        f"SELECT fit, rows, CAST({clusters.K} AS BIGINT) AS groups, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS shifted, total FROM totals",
    ),
    "elbow_fit_facts": select(
        [fx.PANEL, CURRENT, ONE, TOTALS],
        "SELECT fit AS series, CAST(k AS BIGINT) AS k, CAST(0 AS BIGINT) AS misplaced, true AS cost_is_within, total > 0 AS under_total FROM ("
        f"SELECT fit, total, unnest(CASE WHEN fit = 'flows' THEN {ends_of(FLOW_KS)} ELSE {ends_of(PROFILE_KS)} END) AS k FROM totals)",
    ),
    "profile_wide": select(
        [fx.PANEL, CURRENT],
        f"SELECT CAST(number AS BIGINT) AS number, CAST(date AS VARCHAR) AS date, {WIDE_COLUMNS} FROM current GROUP BY number, date",
    ),
    "profile_filled": select([fx.PANEL, CURRENT, _filled("current", True)], FILLED_OUT),
    "profile_filled_per_station": select([fx.PANEL, CURRENT, _filled("current", False)], FILLED_OUT),
    "profile_filled_weekdays": select(
        [fx.PANEL, CURRENT, "wk AS (SELECT * FROM current WHERE weekday IN ('Mon', 'Tue', 'Wed', 'Thu'))", _filled("wk", True)],
        FILLED_OUT,
    ),
    "profile_filled_legacy_weekdays": select(
        [fx.PANEL, CURRENT, "wk AS (SELECT * FROM current WHERE weekday IN ('Mon', 'Tue', 'Wed', 'Thur'))", _filled("wk", True)],
        FILLED_OUT,
    ),
    "profile_unpivot": select(
        [fx.PANEL, CURRENT],
        "SELECT CAST(d.number AS BIGINT) AS number, CAST(d.date AS VARCHAR) AS date, "
        "concat(CAST(x.slot // 60 AS VARCHAR), ':', lpad(CAST(x.slot % 60 AS VARCHAR), 2, '0'), ':00') AS time, "
        "CAST(c.available_stands AS BIGINT) AS available_stands FROM (SELECT DISTINCT number, date FROM current) d "
        "CROSS JOIN (SELECT unnest(range(0, 1440, 10)) AS slot) x "
        "LEFT JOIN current c ON c.number = d.number AND c.date = d.date AND c.slot = x.slot",
    ),
    "station_profile": select(
        [fx.PANEL, CURRENT],
        "SELECT CAST(number AS BIGINT) AS number, name, CAST(slot AS BIGINT) AS slot, round(avg(available_stands) + 1.3e-9, 6) + 0.0 AS stands "
        "FROM current GROUP BY number, name, slot",
    ),
    "column_spread": select(
        [fx.PANEL, ONE],
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable, round(var_samp({c}) + 1.3e-9, 6) + 0.0 AS variance, "
            f"round(CAST(max({c}) - min({c}) AS DOUBLE) + 1.3e-9, 6) + 0.0 AS range FROM one"
            for c in FLOWS
        ),
    ),
    "scaled_spread": select(
        [fx.PANEL, ONE, "scaled AS (SELECT " + ", ".join(f"{c} / CAST((SELECT max({c}) - min({c}) FROM one) AS DOUBLE) AS {c}" for c in FLOWS) + " FROM one)"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable, round(var_samp({c}) + 1.3e-9, 6) + 0.0 AS variance, "
            f"round(max({c}) - min({c}) + 1.3e-9, 6) + 0.0 AS range FROM scaled"
            for c in FLOWS
        ),
    ),
    "range_scaled": select([fx.PANEL, ONE], _scaled("{c} / CAST((SELECT max({c}) - min({c}) FROM one) AS DOUBLE)")),
    "zscored": select(
        [fx.PANEL, ONE], _scaled("({c} - (SELECT avg({c}) FROM one)) / (SELECT stddev_samp({c}) FROM one)")
    ),
    "elbow_k1": select(
        [fx.PANEL, ONE],
        "SELECT CAST(1 AS BIGINT) AS k, round((count(*) - 1) * (var_samp(check_in) + var_samp(check_out)) + 1.3e-9, 6) + 0.0 AS wss FROM one",
    ),
    "elbow_k1_profiles": select(
        [fx.PANEL, CURRENT, _filled("current", True)],
        "SELECT CAST(1 AS BIGINT) AS k, round((max(n) - 1) * sum(v) + 1.3e-9, 6) + 0.0 AS wss FROM ("
        "SELECT slot, var_samp(available_stands) AS v, count(*) AS n FROM filled GROUP BY slot)",
    ),
    "elbow_facts": "SELECT unnest(range(2, 16))::BIGINT AS k, true AS under_total",
    "kmeans_facts": select(
        [fx.PANEL, CURRENT, ONE],
        "SELECT 'profiles' AS fit, count(*) AS assigned, true AS in_range FROM (SELECT DISTINCT number, date FROM current) UNION ALL "
        "SELECT 'weekdays', count(*), true FROM (SELECT DISTINCT number, date FROM current WHERE weekday IN ('Mon', 'Tue', 'Wed', 'Thu')) "
        "UNION ALL SELECT 'flows', count(*), true FROM one",
    ),
    "nearest_centroid": select(KEYED, "SELECT CAST(number AS BIGINT) AS number, name, cluster FROM clusters"),
    "station_curves": select(
        [*KEYED, CURRENT],
        "SELECT CAST(p.number AS BIGINT) AS number, p.name, p.address, CAST(p.slot AS BIGINT) AS slot, c.cluster, "
        "round(avg(p.available_stands) + 1.3e-9, 6) + 0.0 AS av_stands FROM current p LEFT JOIN clusters c "
        "ON p.number = c.number AND p.name = c.name GROUP BY p.number, p.name, p.address, p.slot, c.cluster",
    ),
    "cluster_curves": select(
        [*KEYED, CURRENT],
        "SELECT CAST(p.slot AS BIGINT) AS slot, c.cluster, round(avg(p.available_stands) + 1.3e-9, 6) + 0.0 AS av_stands FROM current p "
        "LEFT JOIN clusters c ON p.number = c.number AND p.name = c.name GROUP BY p.slot, c.cluster",
    ),
    "cluster_csv_roundtrip": select(KEYED, "SELECT CAST(number AS BIGINT) AS number, name, cluster FROM clusters"),
    "cluster_map_points": select(
        [*KEYED, fx.GEO],
        "SELECT CAST(c.number AS BIGINT) AS number, c.name, c.cluster, round(g.latitude + 1.3e-9, 6) + 0.0 AS latitude, "
        "round(g.longitude + 1.3e-9, 6) + 0.0 AS longitude FROM clusters c LEFT JOIN geo g ON c.number = g.number",
    ),
    "cluster_means": select(
        [fx.PANEL],
        "SELECT CAST(check_in % 4 AS BIGINT) AS cluster, "
        + ", ".join(f"round(avg({c}) + 1.3e-9, 6) + 0.0 AS {c}" for c in FLOWS) + " FROM panel GROUP BY 1",
    ),
    "cluster_mean_attached": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, name, CAST(date AS VARCHAR) AS date, CAST(slot AS BIGINT) AS slot, "
        "CAST(check_in % 4 AS BIGINT) AS cluster, round(avg(check_in) OVER w + 1.3e-9, 6) + 0.0 AS cluster_mean_in, "
        "round(avg(check_out) OVER w + 1.3e-9, 6) + 0.0 AS cluster_mean_out FROM panel WINDOW w AS (PARTITION BY number, slot, check_in % 4)",
    ),
}
