"""Fleet-maintenance analytics on PySpark: visit logs in, four indicators per machine out."""

__version__ = "0.1.0"
