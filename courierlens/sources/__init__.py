"""Input tables: schemas, the catalog that binds them, and session settings."""
