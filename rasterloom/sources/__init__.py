"""Where pixels come from and results go to."""
