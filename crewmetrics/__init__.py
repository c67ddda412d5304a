"""Production-operations KPIs as PySpark DataFrame operators and reports."""
