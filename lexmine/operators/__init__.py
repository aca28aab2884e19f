"""DataFrame -> DataFrame operators over keyword records."""
