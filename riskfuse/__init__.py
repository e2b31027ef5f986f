"""riskfuse: multi-signal transaction-risk scoring as Spark DataFrame operators.

Layout
------
functions/  Column -> Column builders (native Spark expressions, codegen friendly)
operators/  DataFrame -> DataFrame operators (fusion, validation, metrics, datasets, ml)
sources/    readers and writers (CSV, JSON lines, protocol text, transcripts)
plans/      test views over the driver tables and the query registry + DuckDB oracles
streaming/  Structured Streaming variants of the batch operators
"""

__version__ = "0.1.0"
