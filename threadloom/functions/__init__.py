"""Threadloom."""
