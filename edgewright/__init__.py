"""Evidenced architecture graphs of mixed TypeScript and Python code bases, as Spark jobs."""
