"""Operators of a text-corpus pipeline: quality, deduplication, mixing, sharding, scoring, tokens.

Common rules.  Inputs may carry any other columns; inside an operator all working columns
begin with an underscore.  A null text counts as empty.  ``doc_id`` is an integer key; rows
without one come after all others.  Words are ``[^\\x20\\x09-\\x0D]+``.
"""
