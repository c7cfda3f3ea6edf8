"""jsonlake: JSON-shaped queries over Spark tables and quads."""
