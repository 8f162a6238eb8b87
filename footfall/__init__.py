"""Customer-journey analytics on Spark DataFrames."""

from footfall.session import clear_scratch, configure, materialize, scratch_path

__all__ = ["clear_scratch", "configure", "materialize", "scratch_path"]
