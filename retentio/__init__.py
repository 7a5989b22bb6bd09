"""retentio — customer-churn analytics as Spark jobs (DataFrame plans and pyspark.ml stages)."""

__version__ = "0.1.0"
