"""tablesync: keeps the tables of two record systems consistent, as Spark jobs."""

__version__ = "0.1.0"
