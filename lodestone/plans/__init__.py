"""Registered queries: operators applied to whole tables, with SQL twins."""
