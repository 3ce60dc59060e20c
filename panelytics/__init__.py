"""Analytics over daily panels (one row per entity and day) as plain Spark DataFrame plans."""

from panelytics.session import build_session

__all__ = ["build_session"]
