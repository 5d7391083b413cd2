"""Column expressions: time, flows, queueing formulas, stock verdicts."""
