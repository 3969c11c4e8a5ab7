"""lexichron: Spark-native analytics of text corpora over time.

Everything takes and returns DataFrames.  ``operators`` holds the relational
operators, ``functions`` column expressions, ``sources`` readers and writers,
``plans`` the registered queries with their SQL, ``streaming`` the incremental
form of the bag merge, and ``llm`` the operators for training-data corpora;
nothing outside ``llm`` imports it.
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
