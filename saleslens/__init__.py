"""Customer cross-sell analytics as plain DataFrame-to-DataFrame functions."""
