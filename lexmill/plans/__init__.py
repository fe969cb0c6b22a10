"""See the modules of lexmill.plans."""
