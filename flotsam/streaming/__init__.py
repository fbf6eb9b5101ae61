"""streaming of the marine-debris engine."""
