"""Structured Streaming form of the triage job."""
