"""Structured Streaming form of the municipality roll-up (the reference has no
streaming operators; this runs its own roll-up over arriving files)."""
