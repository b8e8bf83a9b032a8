"""DataFrame operators of the tape warehouse."""
