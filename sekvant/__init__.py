"""sekvant: Spark-native classification of repetitive elements from profile hits.

Everything relational is declared on DataFrames; Python runs only where a
semantics is inherently sequential, and then Arrow-batched.
"""

__version__ = "0.1.0"
