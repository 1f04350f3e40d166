"""odspark — Spark-native transit origin–destination analytics.

Every public function takes and returns Spark DataFrames. Nothing is
collected to the driver; every operator runs for all service dates and
routes in one job, with ``service_date`` part of every key.
"""

from odspark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
