"""memspark: agent-memory analytics on Spark."""
