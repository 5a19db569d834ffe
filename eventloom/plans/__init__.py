"""Jobs composed of sources, operators and tables."""
