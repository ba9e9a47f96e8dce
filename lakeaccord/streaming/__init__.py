"""Incremental work. All inputs are files read once, so nothing here is a stream."""
