"""functions of capturelake."""
