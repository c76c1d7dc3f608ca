"""Batch and streaming jobs for fleets of room-mounted radars, written on Spark DataFrames."""
