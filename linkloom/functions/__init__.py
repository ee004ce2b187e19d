"""Part of the page-graph engine."""
