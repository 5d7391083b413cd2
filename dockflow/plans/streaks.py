"""Runs of consecutive check-ins and check-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dockflow.operators.series import with_reset_sum


def running_flows(panel: DataFrame) -> DataFrame:
    """Per station the sums of in and out since their last empty slot.

    A station has at most 144 slots a day, which bounds the window.
    """
    order = ["date", "slot", "name", "address"]
    summed = with_reset_sum(panel, "check_in", "run_in", ["number"], order)
    return with_reset_sum(summed, "check_out", "run_out", ["number"], order)
