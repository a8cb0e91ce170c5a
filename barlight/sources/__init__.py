"""Sources of the market-analytics engine."""
