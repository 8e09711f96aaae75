"""Audits bound to the test tables: the datasets, the registered queries and their SQL."""
