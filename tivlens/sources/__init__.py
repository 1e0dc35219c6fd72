"""Where data comes from and goes to."""
