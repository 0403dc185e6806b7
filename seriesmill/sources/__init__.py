"""Where samples come from and go to."""
