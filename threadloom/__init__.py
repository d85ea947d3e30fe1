"""Threadloom: conversation analytics as DataFrame-to-DataFrame transforms on Spark."""
