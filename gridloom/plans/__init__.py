"""From a prompt to a guarded query: routing, guarding, and the registry of queries."""
