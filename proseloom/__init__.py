"""proseloom: prose, script and quality-control analytics on PySpark DataFrames."""

from .session import build_session

__all__ = ["build_session"]
