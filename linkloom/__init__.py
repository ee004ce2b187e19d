"""Spark-native page-graph engine: crawl, maintain and query a directed graph of pages."""
