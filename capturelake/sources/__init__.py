"""sources of capturelake."""
