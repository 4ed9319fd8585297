"""tessera: querying and reshaping columnar datasets with PySpark."""
