"""mnemora: knowledge-memory analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions and UDFs), ``operators``
(relational, retrieval and graph operators), ``sources`` (readers and writers),
``plans`` (queries composed from operators, with their DuckDB twins) and
``streaming`` (incremental ingest).
"""
