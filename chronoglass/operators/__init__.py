"""Operators over readings (id, us, v): us is microseconds since 1970, v may be null where a grid has a gap."""
