"""Spark-native HTML analytics: columns of raw HTML to relations of nodes, tokens and errors."""
