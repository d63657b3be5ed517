"""Named queries: an operator over the stored tables, with the SQL it must agree with."""
