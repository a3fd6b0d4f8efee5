"""The codec and everything that runs on token arrays."""
