"""Table scans, model views, the CSV knowledge base and sinks."""
