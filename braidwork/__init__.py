"""braidwork: a PySpark-native engine for knowledge-graph construction and analytics."""
