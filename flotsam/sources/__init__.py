"""sources of the marine-debris engine."""
