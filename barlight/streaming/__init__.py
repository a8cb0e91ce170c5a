"""Streaming of the market-analytics engine."""
