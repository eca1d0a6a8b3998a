"""Column functions: bytes, addresses, names, text and TLS fingerprints."""
