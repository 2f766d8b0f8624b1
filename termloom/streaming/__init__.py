"""Streaming form of the append step."""
