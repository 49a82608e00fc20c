"""Registered queries: each plan module offers QUERIES and ORACLE."""
