"""pyspark.ml estimators, model registry, training, tuning and scoring."""
