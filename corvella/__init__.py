"""Documents, e-mail events and processing logs as Spark tables."""
