"""Structured Streaming twins of the stateful batch operators."""
