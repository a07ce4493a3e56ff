"""Conversational analytics and retrieval as Spark DataFrame jobs."""
