"""Where models and their rows come from."""
