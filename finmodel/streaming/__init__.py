"""Change events as streams (an extension: the models themselves are batch)."""
