"""Field-survey analytics as Spark jobs: labels, masks, models, tracks and routes."""

__version__ = "0.1.0"
