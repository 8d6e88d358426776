"""Conversation-memory analytics on Spark DataFrames."""
