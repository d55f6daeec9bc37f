"""barlattice: a PySpark-native engine for multi-asset bar data and research ledgers.

Every operator is a function from DataFrames to DataFrames.  Subpackages:

* ``sources``    readers and writers (parquet tables, zipped kline CSV, JSON lines, atomic state)
* ``functions``  column expressions and scalar statistics
* ``operators``  the operators themselves
* ``plans``      named queries over the test tables with their SQL counterparts
* ``streaming``  Structured Streaming versions of the stateful operators
* ``llm``        text and training-data operators (optional, imported by nothing here)
"""
