"""Functions of the market-analytics engine."""
