"""Plans of the trace engine."""
