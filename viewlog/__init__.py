"""Page-view analytics and table-workload measurement on Spark."""
