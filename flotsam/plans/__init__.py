"""plans of the marine-debris engine."""
