"""stemma: literature-graph analytics and text-corpus operators on Spark."""
