"""Transition probabilities of a finite queue as column expressions.

``capacity`` C, ``start`` s, ``target`` sigma, ``rho`` the ratio of the mean
inter-arrival times, ``lam`` and ``mu`` the two means, ``t`` the elapsed time.
Sums and searches over 1..C or 0..C are array functions inside one row: no
rows are multiplied, nothing is shuffled.  A NULL parameter yields NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERVICE_LEVEL = 0.95


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def steady_state(target, capacity, rho) -> Column:
    target, capacity, rho = _col(target), _col(capacity), _col(rho)
    general = F.try_divide(1 - rho, 1 - F.pow(rho, capacity + 1)) * F.pow(rho, target)
    return F.when(rho == 1.0, F.try_divide(F.lit(1.0), capacity + 1)).otherwise(general)


def decay_rate(m, lam, mu, capacity) -> Column:
    m, lam, mu, capacity = _col(m), _col(lam), _col(mu), _col(capacity)
    angle = F.try_divide(m * math.pi, capacity + 1)
    return lam + mu - 2.0 * F.sqrt(lam * mu) * F.cos(angle)


def mode_weight(m, mu, rate, start, capacity, rho, target) -> Column:
    m, mu, rate = _col(m), _col(mu), _col(rate)
    start, capacity, rho, target = _col(start), _col(capacity), _col(rho), _col(target)

    def wave(level: Column) -> Column:
        step = F.try_divide(m * math.pi, capacity + 1)
        return F.sin(step * level) - F.sqrt(rho) * F.sin(step * (level + 1))

    return F.try_divide(mu, rate) * wave(start) * wave(target)


def mode_sum(capacity, start, rho, target, lam, mu, t) -> Column:
    """Sum over m = 1..C; NULL when C < 1, where no mode exists."""
    capacity, t = _col(capacity), _col(t)

    def add(total: Column, m: Column) -> Column:
        rate = decay_rate(m, lam, mu, capacity)
        weight = mode_weight(m, mu, rate, start, capacity, rho, target)
        return total + F.try_divide(weight * F.exp(-rate * t), rate)

    modes = F.sequence(F.lit(1), capacity.cast("int"))
    return F.when(capacity >= 1, F.aggregate(modes, F.lit(0.0), add))


def transition(capacity, start, target, rho, lam, mu, t) -> Column:
    capacity, start, target, rho = _col(capacity), _col(start), _col(target), _col(rho)
    scale = F.try_divide(2.0 * F.pow(rho, (target - start) / 2.0), capacity + 1)
    total = mode_sum(capacity, start, rho, target, lam, mu, t)
    return steady_state(target, capacity, rho) * _col(t) - scale * total


def mean_transition(capacity, start, target, rho, lam, mu, t_start, t_end) -> Column:
    """(P(t_start) - P(t_end)) / t_start."""
    t_start, t_end = _col(t_start), _col(t_end)
    rise = transition(capacity, start, target, rho, lam, mu, t_start) - transition(
        capacity, start, target, rho, lam, mu, t_end
    )
    return F.try_divide(rise, t_start)


def _service(capacity, target, rho, lam, mu, t_start, t_end) -> Column:
    """Array of 1 - mean_transition for the starts 0..C.

    The same value as calling mean_transition per start, arranged so that what
    does not depend on the start is computed once per mode: each mode m adds its
    coefficient times the start's wave to all starts.
    """
    capacity, target, rho = _col(capacity), _col(target), _col(rho)
    lam, mu, t_start, t_end = _col(lam), _col(mu), _col(t_start), _col(t_end)
    step, root = F.try_divide(F.lit(math.pi), capacity + 1), F.sqrt(rho)

    def mode(m: Column) -> Column:
        rate = decay_rate(m, lam, mu, capacity)
        wave = F.sin(m * step * target) - root * F.sin(m * step * (target + 1))
        fade = F.exp(-rate * t_start) - F.exp(-rate * t_end)
        return F.struct(
            (m * step).alias("angle"), F.try_divide(mu * wave * fade, rate * rate).alias("weight")
        )

    def add_mode(sums: Column, part: Column) -> Column:
        def one(total: Column, s: Column) -> Column:
            wave = F.sin(part["angle"] * s) - root * F.sin(part["angle"] * (s + 1))
            return total + part["weight"] * wave

        return F.transform(sums, one)

    top = capacity.cast("int")
    modes = F.transform(F.sequence(F.lit(1), top), mode)
    sums = F.aggregate(modes, F.array_repeat(F.lit(0.0), top + 1), add_mode)
    steady = steady_state(target, capacity, rho) * (t_start - t_end)

    def service(total: Column, s: Column) -> Column:
        scale = F.try_divide(2.0 * F.pow(rho, (target - s) / 2.0), capacity + 1)
        return 1 - F.try_divide(steady - scale * total, t_start)

    return F.when(capacity >= 1, F.transform(sums, service))


def _good_starts(capacity, target, rho, lam, mu, t_start, t_end, level: float) -> Column:
    values = _service(capacity, target, rho, lam, mu, t_start, t_end)
    return F.transform(values, lambda v, s: F.when(v >= level, s))


def lower_bound(capacity, rho, lam, mu, t_start, t_end, level: float = SERVICE_LEVEL) -> Column:
    """Smallest start level that meets the service level, NULL if none does."""
    return F.array_min(_good_starts(capacity, 0.0, rho, lam, mu, t_start, t_end, level))


def upper_bound(capacity, rho, lam, mu, t_start, t_end, level: float = SERVICE_LEVEL) -> Column:
    """Largest start level that meets the service level, -1 if none does."""
    starts = _good_starts(capacity, capacity, rho, lam, mu, t_start, t_end, level)
    known = _col(capacity).isNotNull() & _col(rho).isNotNull() & _col(lam).isNotNull()
    found = F.coalesce(F.array_max(starts), F.lit(-1))
    return F.when(known & _col(mu).isNotNull(), found)
