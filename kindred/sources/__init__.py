"""Landing files, archives and bucketed tables."""
