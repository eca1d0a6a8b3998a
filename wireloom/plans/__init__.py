"""Languages compiled to Columns, and the registered queries."""
