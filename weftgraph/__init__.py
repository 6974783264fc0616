"""weftgraph: search, analytics and incremental ETL over property graphs, documents and chats on Spark.

Everything is a function from DataFrames to DataFrames. The subpackage ``llm`` holds the operators for
training data; nothing else in the package imports it.
"""

__version__ = "0.1.0"
