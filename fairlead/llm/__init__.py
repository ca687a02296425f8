"""Operators for preparing training corpora: search, extraction, token files, classifiers, mixing, pseudonyms and duplicates.

Nothing outside this folder imports it; ``fairlead.llm.registry`` lists the queries.
"""
