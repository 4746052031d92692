"""tessera: fund analytics, knowledge retrieval and corpus preparation on PySpark DataFrames."""
