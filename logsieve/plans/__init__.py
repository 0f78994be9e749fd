"""Jobs that chain operators end to end, and the driver query catalogue."""
