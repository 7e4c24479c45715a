"""Training-data operators on text tables; nothing else in the library imports this subpackage."""
