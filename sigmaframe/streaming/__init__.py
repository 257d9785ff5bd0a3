"""Stateful filters for Structured Streaming."""
