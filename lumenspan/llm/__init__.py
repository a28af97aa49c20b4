"""Training-data operators.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``oracles`` the SQL that checks those which SQL can express.
"""
