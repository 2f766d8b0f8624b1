"""End-to-end steps built from sources, operators and sinks."""
