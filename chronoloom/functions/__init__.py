"""Core time-series expressions and reducers."""
