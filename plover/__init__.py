"""Plover: research analytics and corpus preparation on PySpark."""
