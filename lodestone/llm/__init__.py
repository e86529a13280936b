"""Operators of a training-data pipeline, each usable on its own.

Every module holds one operator with a general interface; ``queries``
registers the thin ``opN_<name>`` queries that derive digest columns from
them.  Nothing outside this folder imports it.
"""
