"""prosemill: a Spark-native engine for deterministic checks of prose."""
