"""mediaspan: catalogue analytics for media libraries as lazy PySpark plans."""
