"""Operators that prepare training data from chats, source code and documents. Nothing outside imports this package."""
