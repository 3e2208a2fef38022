"""quarry functions package."""
