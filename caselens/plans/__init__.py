"""Plan shapes that several operators share."""
