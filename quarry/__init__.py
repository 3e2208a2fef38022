"""quarry: a search and analytics engine expressed as Spark DataFrame plans."""
