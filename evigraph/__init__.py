"""Evidence-graph analytics as PySpark DataFrame transforms."""
