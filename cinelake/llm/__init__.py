"""Training-data operators: corpus operators, their queries and DuckDB SQL.

Nothing else in the package imports this subpackage; ``__spark_entry__.py``
adds its queries only when it can be imported.
"""
