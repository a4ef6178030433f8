"""Conversation-graph analytics on Spark DataFrames."""
