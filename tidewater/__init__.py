"""tidewater: vessel-track analytics expressed as Spark DataFrame plans.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing is collected to the driver except scalars that are
provably small (counts, min/max, a handful of percentile edges).
"""

__version__ = "0.1.0"
