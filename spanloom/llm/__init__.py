"""Training-data operators: filtering, media, sharding, mixing, packing and chat cleaning.

Nothing else in the library imports this subpackage.
"""
