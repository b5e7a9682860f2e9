"""Structured Streaming: job status, edit logs, continuous intake."""
