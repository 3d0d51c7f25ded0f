"""Stateful jobs over event streams."""
