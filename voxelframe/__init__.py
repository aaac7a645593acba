"""Spark-native analytics for chunked volumes and the surfaces traced through them."""
