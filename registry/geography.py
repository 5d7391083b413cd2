"""Occupancy heatmaps and geographic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockflow.plans import occupancy
from registry import fixture as fx
from registry.fixture import plain, select

QUERIES = {
    "heatmap_all": lambda s, d: plain(occupancy.heatmap(fx.panel(s, d))),
    "heatmap_station": lambda s, d: plain(occupancy.heatmap(fx.panel(s, d), by_station=True)),
    "heatmap_rows_station": lambda s, d: plain(
        occupancy.with_station_slot_mean(fx.panel(s, d)).select(
            "number", "name", "date", "slot", "weekday", "avg_bikes", "stands"
        )
    ),
    "heatmap_rows_all": lambda s, d: plain(
        occupancy.with_overall_slot_mean(fx.panel(s, d)).select(
            "number", "name", "date", "slot", "weekday", "avg_bikes"
        )
    ),
    "station_titles": lambda s, d: plain(occupancy.station_titles(fx.panel(s, d), "Station 1")),
    "geo_join": lambda s, d: plain(occupancy.with_coordinates(fx.panel(s, d), fx.stations(s, d))),
    "geo_missing": lambda s, d: plain(
        occupancy.without_coordinates(fx.panel(s, d), fx.stations(s, d))
    ),
    "geo_right_join": lambda s, d: plain(
        occupancy.stations_with_panel(fx.panel(s, d), fx.stations(s, d).where(F.col("number") < 12))
    ),
    "daypart_free_docks": lambda s, d: plain(
        occupancy.map_part_free_docks(fx.panel(s, d), fx.stations(s, d))
    ),
    "station_totals_geo": lambda s, d: plain(
        occupancy.station_totals(fx.panel(s, d), fx.stations(s, d))
    ),
}

PLACE = "round(latitude + 1.3e-9, 6) + 0.0 AS latitude, round(longitude + 1.3e-9, 6) + 0.0 AS longitude"
KEYS = (
    "CAST(number AS BIGINT) AS number, name, CAST(date AS VARCHAR) AS date, CAST(slot AS BIGINT) AS slot, weekday"
)
PANEL_OUT = fx.PANEL_OUT.replace("number::BIGINT AS number, name, address", "p.number::BIGINT AS number, p.name, p.address")

SQL = {
    "heatmap_all": select(
        [fx.PANEL],
        "SELECT CAST(slot AS BIGINT) AS slot, weekday, round(avg(bike_stands - available_stands) + 1.3e-9, 6) + 0.0 AS avg_bikes, "
        "CAST(max(bike_stands) AS BIGINT) AS bike_stands FROM panel GROUP BY slot, weekday",
    ),
    "heatmap_station": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, CAST(slot AS BIGINT) AS slot, weekday, "
        "round(avg(bike_stands - available_stands) + 1.3e-9, 6) + 0.0 AS avg_bikes, "
        "CAST(max(bike_stands) AS BIGINT) AS bike_stands FROM panel GROUP BY number, slot, weekday",
    ),
    "heatmap_rows_station": select(
        [fx.PANEL],
        f"SELECT {KEYS}, round(avg(bike_stands - available_stands) OVER w + 1.3e-9, 6) + 0.0 AS avg_bikes, "
        "CAST(max(bike_stands) OVER w AS BIGINT) AS stands FROM panel WINDOW w AS (PARTITION BY number, slot, weekday)",
    ),
    "heatmap_rows_all": select(
        [fx.PANEL],
        f"SELECT {KEYS}, round(avg(bike_stands - available_stands) OVER (PARTITION BY slot, weekday) + 1.3e-9, 6) + 0.0 AS avg_bikes "
        "FROM panel",
    ),
    "station_titles": select(
        [fx.PANEL],
        "SELECT DISTINCT CAST(number AS BIGINT) AS number, address, CAST(bike_stands AS BIGINT) AS bike_stands "
        "FROM panel WHERE address <> 'Station 1'",
    ),
    "geo_join": select(
        [fx.PANEL, fx.GEO],
        f"SELECT {PANEL_OUT}, {PLACE} FROM panel p LEFT JOIN geo g ON p.number = g.number",
    ),
    "geo_missing": select(
        [fx.PANEL, fx.GEO],
        "SELECT CAST(p.number AS BIGINT) AS number, count(*) AS count FROM panel p LEFT JOIN geo g ON p.number = g.number "
        "WHERE g.latitude IS NULL OR g.longitude IS NULL GROUP BY p.number",
    ),
    "geo_right_join": select(
        [fx.PANEL, fx.GEO],
        f"SELECT {PANEL_OUT}, {PLACE} FROM (SELECT * FROM geo WHERE number < 12) g RIGHT JOIN panel p ON p.number = g.number",
    ),
    "daypart_free_docks": select(
        [fx.PANEL, fx.GEO, """
parts AS (SELECT *, CASE WHEN weekday IN ('Sat', 'Sun') THEN 'weekend' ELSE 'weekday' END AS day_type,
                 CASE WHEN slot // 60 BETWEEN 5 AND 10 THEN 'morning' WHEN slot // 60 BETWEEN 11 AND 16 THEN 'afternoon'
                      WHEN slot // 60 BETWEEN 17 AND 22 THEN 'evening' END AS part FROM panel)"""],
        "SELECT CAST(p.number AS BIGINT) AS number, p.name, day_type, part, round(avg(available_stands) + 1.3e-9, 6) + 0.0 AS stands, "
        f"{PLACE}, round(avg(available_stands) * 0.4 + 1.3e-9, 6) + 0.0 AS size FROM parts p LEFT JOIN geo g ON p.number = g.number "
        "WHERE part IS NOT NULL GROUP BY p.number, p.name, day_type, part, latitude, longitude",
    ),
    "station_totals_geo": select(
        [fx.PANEL, fx.GEO],
        "SELECT CAST(p.number AS BIGINT) AS number, CAST(sum(check_in) AS BIGINT) AS check_in, "
        f"CAST(sum(check_out) AS BIGINT) AS check_out, {PLACE} FROM panel p LEFT JOIN geo g ON p.number = g.number "
        "GROUP BY p.number, latitude, longitude",
    ),
}
