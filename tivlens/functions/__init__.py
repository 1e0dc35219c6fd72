"""Column-level helpers. Everything here stays inside Catalyst expressions."""
