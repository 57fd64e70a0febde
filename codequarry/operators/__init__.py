"""Queries over nodes, edges, blocks, vectors and traces: functions from DataFrames to DataFrames.

Nothing is collected.  Every limit stands on a total order (the last key is the id),
so results don't depend on partitioning.  Inputs that the caller may have
many of (seeds, frames, queries) are DataFrames, never loops.
"""
