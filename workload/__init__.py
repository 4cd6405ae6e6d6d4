"""The operators bound to the given tables, each with its DuckDB SQL where SQL can say the same."""
