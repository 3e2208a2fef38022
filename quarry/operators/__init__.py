"""quarry operators package."""
