"""Readers of chat logs and notes, and the store of collections."""
