"""tablewright: table preparation for analytics and learning, planned by Spark."""

__version__ = "0.1.0"
