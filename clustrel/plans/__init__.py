"""Named queries and their SQL equivalents."""
