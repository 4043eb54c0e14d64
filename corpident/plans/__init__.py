"""Rules as data: the catalog, its tables for Spark, the rule language, and its load checks."""
