"""Incremental (streaming) builds."""
