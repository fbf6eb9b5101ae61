"""functions of the marine-debris engine."""
