"""seqlake: a PySpark-native analytics engine for viral metagenomics tables."""

__version__ = "0.1.0"
