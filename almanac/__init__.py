"""Listings consolidation and discovery as DataFrame operators on Spark."""
