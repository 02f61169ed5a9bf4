"""Conversation analytics expressed as Spark DataFrame plans."""
