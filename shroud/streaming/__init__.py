"""Streams: the batch operators over unbounded inputs, and the state they need."""
