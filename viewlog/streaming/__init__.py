"""Timing statistics over time intervals, in batch and as a stream."""
