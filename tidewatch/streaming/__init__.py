"""Online forms of the panel, scoring and alarm operators on Structured Streaming."""
