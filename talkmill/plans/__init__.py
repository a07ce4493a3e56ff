"""End-to-end flows and the registry of named queries."""
