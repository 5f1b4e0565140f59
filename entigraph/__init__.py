"""Entity resolution over person and company records, as Spark DataFrame transformations."""
