"""juristrata: knowledge-graph analytics over legal documents, on PySpark DataFrames."""
