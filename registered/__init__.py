"""Registered queries: each one runs an operator over the whole given tables, with the SQL it is
checked against where SQL can say it."""
