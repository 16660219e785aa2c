"""Data engine for code localization on PySpark: tasks, trajectories, code search, labels, scores."""
