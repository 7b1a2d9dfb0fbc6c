"""Every product on the star schema, and the same in SQL for an independent engine."""
