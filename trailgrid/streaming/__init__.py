"""Change journals as streams."""
