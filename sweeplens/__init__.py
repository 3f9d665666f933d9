"""sweeplens: sweep and evaluation analytics as PySpark DataFrame operators."""
