"""Plan builders that several operators share."""
