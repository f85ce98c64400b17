"""callspark: Spark jobs over recorded conversations and text corpora."""
