"""Readers, panel builders and sinks."""
