"""Readers, and the sinks that write what they read."""
