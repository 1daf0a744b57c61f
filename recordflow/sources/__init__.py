"""Where records come from and where output goes."""
