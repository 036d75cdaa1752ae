"""Runnable jobs: python -m jobs.<name> CONFIG [--set key=value]."""
