"""Mail and table sources."""
