"""Column-level functions; each returns a Spark Column built from built-ins."""
