"""Named queries over the bench tables and their SQL counterparts."""
