"""Queries: importing the registry registers all of the core's."""
