"""Registered queries: each module has QUERIES (Spark) and ORACLES (the same in DuckDB SQL)."""
