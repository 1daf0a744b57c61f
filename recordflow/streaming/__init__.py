"""Programs on Structured Streaming sources."""
