"""Operators of the market-analytics engine."""
