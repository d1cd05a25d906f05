"""Structured Streaming: windows with watermarks, request de-duplication, key replay, and expiry by timers."""
