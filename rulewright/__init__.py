"""Rule, evidence and label analytics as PySpark DataFrame operators."""
