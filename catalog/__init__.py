"""The registered queries: what each runs on Spark and the SQL that checks it."""
