"""Keyed time-series recordings on Spark: traces, events, pairs, bursts, stimuli and grouped statistics."""
