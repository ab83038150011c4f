"""The batch operators that carry over to Structured Streaming."""
