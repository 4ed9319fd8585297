"""Training-data operators: ten independent operators on document, page and benchmark tables.

Nothing outside this subpackage imports it.  Each module has one operator with a general
interface and one thin ``opN_*`` query; ``registry.py`` gathers the queries.
"""
