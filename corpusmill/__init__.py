"""Document and table analytics as Spark DataFrame, SQL and streaming jobs."""

from .config import Settings
from .session import get_session, ship_package

__all__ = ["Settings", "get_session", "ship_package"]
