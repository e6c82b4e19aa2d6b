"""tesserix: analytics over tiled-map archives, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
