"""flowlens: network-flow threat analytics as Spark DataFrame, MLlib and Structured Streaming jobs."""

from flowlens.config import DEFAULT, FlowConfig

__all__ = ["DEFAULT", "FlowConfig"]
