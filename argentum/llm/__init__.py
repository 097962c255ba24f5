"""Operators for preparing training text at scale.

Each module holds one operator with its general interface.  ``entry`` holds the
thin queries ``opN_<name>`` and their SQL.
"""
