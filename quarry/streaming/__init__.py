"""quarry streaming package."""
