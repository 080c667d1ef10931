"""Structured Streaming jobs. Each equals its batch operator on the same, in-order input."""
