"""A Spark-native analytics engine for parcel and freight operations."""
