"""Training-data operators: quality, search, tokens, de-duplication, archives, packing, privacy.

Nothing outside this package imports it.  ``queries.py`` lists the registered queries.
"""
