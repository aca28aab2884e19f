"""Incremental runs: the row-wise operators on a stream of captured records."""
