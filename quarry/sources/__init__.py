"""quarry sources package."""
