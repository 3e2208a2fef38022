"""quarry plans package."""
