"""Independent DuckDB formulations of every deterministic analysis (the correctness oracle)."""
