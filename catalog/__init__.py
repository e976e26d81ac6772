"""The registered queries, each with the SQL that gives the same rows on the same tables."""
