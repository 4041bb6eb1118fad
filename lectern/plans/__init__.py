"""Query registry of the engine."""
