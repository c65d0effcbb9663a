"""Building blocks for layered analytics and training-data pipelines on PySpark."""
