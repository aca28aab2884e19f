"""Table, CSV and report sinks."""
