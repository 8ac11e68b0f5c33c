"""All queries outside the llm subpackage, and the SQL they are compared with."""

from kinetrail.queries import arenas, behaviour, comparison, learning, matrix, space, statistics, tracks, training

MODULES = [behaviour, tracks, matrix, space, statistics, comparison, arenas, learning, training]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
