"""Named queries: each is one operator on the driver's tables, beside the SQL that gives the same rows."""
