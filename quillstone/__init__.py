"""Analytics over source-code and text repositories on Spark."""
