"""Parallel-text preparation and translation scoring on Spark DataFrames."""

from pairloom.config import PipelineConfig

__all__ = ["PipelineConfig"]
