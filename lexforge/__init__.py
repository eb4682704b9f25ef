"""Text analytics on PySpark: corpus to dictionary, checks over the dictionary, and evaluation."""
