"""Plans of the market-analytics engine."""
