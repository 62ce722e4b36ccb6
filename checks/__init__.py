"""Queries over the test tables and the DuckDB SQL each one is compared with."""
