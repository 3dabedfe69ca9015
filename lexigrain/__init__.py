"""A PySpark engine for cleaning, validating and matching texts about people, companies and things."""
