"""flotsam: marine-debris analytics as PySpark DataFrame operators."""
