"""Extension: cubes that grow by time steps (Structured Streaming)."""
