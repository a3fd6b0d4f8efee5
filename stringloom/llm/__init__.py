"""Training-data operators over document tables.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; each operator module has a general interface of its own.
"""
