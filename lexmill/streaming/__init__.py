"""See the modules of lexmill.streaming."""
