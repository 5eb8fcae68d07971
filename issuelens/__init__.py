"""Technical-debt analytics over issue text, as Spark DataFrame jobs."""

from issuelens.session import build_session

__all__ = ["build_session"]
