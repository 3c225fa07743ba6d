"""Tables that are changed in place."""
