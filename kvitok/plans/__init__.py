"""Named queries over the sample tables and their oracle SQL."""
