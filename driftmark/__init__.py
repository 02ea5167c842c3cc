"""driftmark: PySpark operators for record quality, change tracking and corpus preparation."""
