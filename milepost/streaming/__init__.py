"""The keyed append as a stream."""
