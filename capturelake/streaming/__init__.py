"""streaming of capturelake."""
