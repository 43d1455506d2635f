"""Training-data operators: each module holds one operator and its ``opN_`` query; ``registry`` lists the queries.

Nothing outside this subpackage imports it.
"""
