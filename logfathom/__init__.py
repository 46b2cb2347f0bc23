"""Log analytics as plain PySpark DataFrame transformations.

Every operator has the shape ``f(df, ...) -> DataFrame``: nothing is collected,
no Python function runs per row, and the reference time is always an argument.
``scope`` names the columns that split one table into many independent answers
(tenant, service, day); with no scope the whole table is one answer.
"""

from logfathom.session import prepare

__all__ = ["prepare"]
