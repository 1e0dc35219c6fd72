"""tivlens: exposure-portfolio audit and accumulation on PySpark."""
