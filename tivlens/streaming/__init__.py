"""Row-level rules on arriving records."""
