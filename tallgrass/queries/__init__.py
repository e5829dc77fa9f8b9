"""Registered queries: callables of (session, folder) and, where SQL can say the same, the SQL."""
