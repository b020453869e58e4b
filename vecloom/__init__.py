"""A PySpark engine that keeps derived vectors correct while their source tables change."""
