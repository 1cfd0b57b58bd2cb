"""Where packet tables come from, and where results go."""
