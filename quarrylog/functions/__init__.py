"""Column functions: query text, time, numbers, execution plans and generated rows."""
