"""Pure ``Column -> Column`` rules (built-in Spark expressions only)."""
