"""Sources and sinks: capture files, JSON lines, tables of the host."""
