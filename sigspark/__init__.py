"""sigspark: a PySpark-native analytics engine for nanopore-style signal data."""
