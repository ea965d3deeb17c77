"""lodegraph: a Spark-first engine for time-decaying knowledge graphs, retrieval and ledgers.

Every operator is a pure DataFrame transform.  Clocks are DOUBLE Unix seconds and the moment of
evaluation (`as_of`) is always an argument, so a query gives the same rows whenever it runs.
"""

__version__ = "0.1.0"
