"""Readers, generators, and the views of plain tables as catalog entities."""
