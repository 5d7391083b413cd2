"""Reusable DataFrame operators that keep every task's share of rows bounded."""
