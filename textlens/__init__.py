"""textlens: labelled short-text analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus column names) and returns a
DataFrame; nothing in a data path is collected to the driver.  Bounded model
parameters (class lists, class centroids) are the only driver-side values.
"""

from textlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
