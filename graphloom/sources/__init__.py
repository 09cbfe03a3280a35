"""Edge and vertex files in, result files out."""
