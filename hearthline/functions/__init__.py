"""Household-panel analytics on Spark."""
