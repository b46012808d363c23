"""Registered queries and the DuckDB SQL that checks them."""
