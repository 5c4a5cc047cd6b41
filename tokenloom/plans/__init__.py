"""Compositions of operators: corpus preparation and step schedules."""
