"""Facts of source files and what they prove."""
