"""plans of capturelake."""
