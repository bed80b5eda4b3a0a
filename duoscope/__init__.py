"""Paired-outcome text analytics on Spark.

Core packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` and ``sinks``, ``plans`` (named queries with their SQL
twins) and ``streaming``.  The optional subpackage ``llm`` holds operators for
training data; nothing outside it imports it.
"""

__version__ = "0.1.0"
