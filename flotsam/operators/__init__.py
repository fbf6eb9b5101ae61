"""operators of the marine-debris engine."""
