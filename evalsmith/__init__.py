"""evalsmith: PySpark operators for building and scoring judge data sets.

Every operator is DataFrame in, DataFrame out, written with Catalyst
expressions. Model calls are the only Python stage (``operators.inference``).
"""

__version__ = "0.1.0"
