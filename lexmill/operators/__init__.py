"""See the modules of lexmill.operators."""
