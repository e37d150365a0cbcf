"""queries of capturelake."""
