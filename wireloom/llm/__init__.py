"""Training-data operators: dedup, archives, media, tokens, mixing, quality,
URL rules and secrets.  Nothing else in the library imports this subpackage."""
