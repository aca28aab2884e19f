"""Keyword mining on Spark: captured responses -> keyword records -> labelled, clustered keyword map."""
