"""tonecairn: a Spark-first engine for catalogues of short signals.

``operators`` hold relational and signal operators, ``functions`` the column
expressions they share, ``sources`` the readers and writers, ``plans`` the
registered queries with their SQL, ``streaming`` the incremental forms.
The subpackage ``llm`` stands alone: nothing outside it imports it.
"""
