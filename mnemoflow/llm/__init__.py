"""Training-data operators: de-duplication, classification, packing, scoring and search.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
