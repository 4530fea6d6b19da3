"""Runs that chain operators from one configuration."""
