"""DuckDB SQL oracles: an independent SQL formulation of every registered query.

The driver runs each string against DuckDB views of the test tables and
compares the result with the Spark query of the same name.
"""
