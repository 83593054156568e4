"""Order-line analytics as Spark DataFrame jobs: quality rules, cleaning, reports."""
