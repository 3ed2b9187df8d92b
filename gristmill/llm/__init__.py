"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this package imports it; ``queries.py`` holds the query table.
"""
