"""Relational operators over packets, flows and events."""
