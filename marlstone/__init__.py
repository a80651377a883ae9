"""marlstone: a PySpark-native engine for catalogs gathered from many overlapping feeds."""

__version__ = "0.1.0"
