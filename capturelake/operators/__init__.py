"""operators of capturelake."""
