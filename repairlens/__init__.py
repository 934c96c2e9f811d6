"""repairlens: DataFrame operators that analyse AI code-repair runs on Spark."""
