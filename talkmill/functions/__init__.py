"""Column expressions for text, language, JSON and lookups."""
