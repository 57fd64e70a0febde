"""Query plans over the given tables: a graph made of them, the queries, and their SQL."""
