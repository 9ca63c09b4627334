"""Readers of tables and builders of the document model."""
