"""PySpark operators for exam content, question banks and learning behaviour."""
