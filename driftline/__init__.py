"""Navigation and inertial-sensor analytics on Spark."""
