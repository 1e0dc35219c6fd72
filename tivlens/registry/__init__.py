"""Queries over the driver's tables and their independent SQL counterparts."""
