"""Revenue operations, territories, contract longevity and churn on Spark DataFrames."""
