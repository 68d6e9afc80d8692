"""lodestar: document knowledge, graph retrieval and corpus operators on PySpark."""
