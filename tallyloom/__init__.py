"""tallyloom: evidence-aware analytics operators as PySpark DataFrame functions."""
