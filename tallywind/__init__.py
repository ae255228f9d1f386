"""Transaction analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

from .session import JobConfig, build_session

__all__ = ["JobConfig", "build_session"]
