"""See the modules of lexmill.functions."""
