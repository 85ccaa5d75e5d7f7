"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` in
:mod:`evoked_spark.llm.registry` hold the registered queries and their SQL.
"""
