"""roadcast — incident impact analytics as Spark DataFrame jobs.

Cleans incident logs, builds layered historical baselines (exact medians,
rates, modes), forecasts new incidents through a fine -> coarse ->
cause-only -> no-data match chain, derives staffing / barricade / advisory
records, allocates a limited budget over many incidents, folds verified
outcomes back into the baselines and evaluates everything on chronological
splits. Every operator is a function DataFrame -> DataFrame.
"""

from roadcast.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
