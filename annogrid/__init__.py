"""annogrid: annotation and corpus analytics on Spark."""
