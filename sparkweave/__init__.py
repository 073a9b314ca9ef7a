"""sparkweave: a Spark-native SQL engine with a small session API."""

from sparkweave.frame import Query, Stage, prettify
from sparkweave.session import Session, Validator, spark_session

__all__ = ["Query", "Session", "Stage", "Validator", "prettify", "spark_session"]
__version__ = "0.1.0"
