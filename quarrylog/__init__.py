"""SQL workload analytics on Spark: log parsing, templates, arrival series, clustering, forecasts and advice."""
