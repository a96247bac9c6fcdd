"""Event-listing analytics on PySpark: text repair, typed extraction, merging,
de-duplication and quality statistics as DataFrame operators."""
