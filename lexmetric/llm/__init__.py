"""Operators for building training data out of documents, pages and chats.

Self-contained: nothing else in the library imports this folder.
"""
