"""Column functions: each takes and returns Columns and stays inside whole-stage code generation
wherever Spark's expressions can say it."""
