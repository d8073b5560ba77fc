"""What is worked out on the driver before a plan is built: the dictionary and skip logic."""
