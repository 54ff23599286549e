"""Sources, sinks and the boundaries where models plug in."""
