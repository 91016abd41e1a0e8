"""DataFrame-to-DataFrame operators of the transit warehouse."""
