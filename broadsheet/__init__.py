"""broadsheet: newspaper-archive analytics and training-data operators on Spark."""
