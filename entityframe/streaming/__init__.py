"""Change streams and views that are kept up to date."""
