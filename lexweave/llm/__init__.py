"""Operators for preparing language-model training corpora.

One module per operator; :mod:`lexweave.llm.queries` holds the thin queries and
their SQL twins.  Nothing outside this package imports it.
"""
