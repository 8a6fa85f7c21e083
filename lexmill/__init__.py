"""Document-to-question-bank analytics as Spark DataFrame jobs."""
