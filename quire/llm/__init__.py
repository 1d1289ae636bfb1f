"""Training-data operators: ten document-level jobs built on one byte-level token kernel.

Nothing outside this folder imports it; deleting the folder leaves the rest of the package working.
"""
