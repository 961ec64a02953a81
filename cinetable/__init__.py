"""Spark-native analytics over time-stamped media metadata.

Core packages: ``sources`` and ``functions`` (readers and column expressions),
``operators`` (joins, windows, aggregates, retrieval), ``streaming``, ``plans``
(lineage and partitioning helpers) and ``queries`` (the registered catalogue).
The optional subpackage ``llm`` holds the training-data operators; nothing in
the core imports it.
"""

__version__ = "0.1.0"
