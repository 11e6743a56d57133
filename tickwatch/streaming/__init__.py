"""Live evaluation with Structured Streaming."""
