"""Tallyforge: catalog reconciliation and data preparation on PySpark."""
