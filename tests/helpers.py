"""Small frames and plain-Python reference calculations for the tests."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime

SNAP = (
    "number int, name string, address string, bike_stands int, "
    "available_bike_stands int, last_update timestamp_ntz"
)
TIE = ["name", "address", "bike_stands", "available_bike_stands"]


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def snap(number, free, when, name=None, stands=40):
    name = name or f"S{number}"
    return (number, name, f"addr {number}", stands, free, at(when))


def frame(spark, rows):
    return spark.createDataFrame(rows, SNAP)


def slot(ts: datetime) -> int:
    return ts.hour * 60 + ts.minute // 10 * 10


def ordered(rows, text_hour=False):
    """Distinct rows per station in the order that defines the changes."""
    per = defaultdict(list)
    for r in set(rows):
        per[r[0]].append(r)
    for rows_ in per.values():
        rows_.sort(
            key=lambda r: (
                r[5].date(),
                str(r[5].hour) if text_hour else f"{r[5].hour:02d}",
                slot(r[5]),
                r[5],
                r[1],
                r[2],
                r[3],
                r[4],
            )
        )
    return per


def changes(rows, text_hour=False):
    out = []
    for number, seq in ordered(rows, text_hour).items():
        prev = None
        for r in seq:
            diff = 0 if prev is None else r[4] - prev
            prev = r[4]
            out.append((r, diff))
    return out


def brute_panel(rows, text_hour=False):
    groups = {}
    for r, diff in changes(rows, text_hour):
        key = (r[0], r[1], r[2], r[5].date(), slot(r[5]))
        g = groups.setdefault(key, [r[3], 0, 0, 0, None])
        g[0] = min(g[0], r[3])
        g[1] += diff
        g[2] += max(diff, 0)
        g[3] += max(-diff, 0)
        g[4] = r[4]
    return {k: tuple(v) for k, v in groups.items()}


def brute_queue(rows):
    """Inter-arrival times by the two joins on (number, last_update)."""
    seq = changes(rows)
    first_seen, gaps = {}, {"in": defaultdict(list), "out": defaultdict(list)}
    for r, _ in seq:
        first_seen[r[0]] = min(first_seen.get(r[0], r[5]), r[5])
    for side, sign in (("in", 1), ("out", -1)):
        last = {}
        for r, diff in seq:
            if diff * sign > 0:
                key = r[:3]
                gap = (r[5] - last[key]).total_seconds() / 60 if key in last else None
                last[key] = r[5]
                gaps[side][(r[0], r[5])].append(gap)
    groups = {}
    for r, diff in seq:
        since = (r[5] - first_seen[r[0]]).total_seconds() / 60
        key = (r[0], r[1], r[2], r[5].date(), slot(r[5]))
        g = groups.setdefault(key, [0, 0, [], []])
        for i in gaps["in"].get((r[0], r[5]), [None]):
            for o in gaps["out"].get((r[0], r[5]), [None]):
                g[0] += max(diff, 0)
                g[1] += max(-diff, 0)
                i2 = since if diff > 0 and i is None else i
                o2 = since if diff < 0 and o is None else o
                if i2 is not None:
                    g[2].append(i2)
                if o2 is not None:
                    g[3].append(o2)
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    return {k: (a, b, mean(x), mean(y)) for k, (a, b, x, y) in groups.items()}
