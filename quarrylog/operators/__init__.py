"""Operators: series, as-of joins, clustering, coverage, forecasts, their combination and errors, advice and replay."""
