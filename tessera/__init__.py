"""tessera: a PySpark-native engine for document retrieval and text analytics."""
