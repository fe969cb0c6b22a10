"""See the modules of lexmill.sources."""
