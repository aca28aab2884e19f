"""From roots to captured responses to keyword records."""
