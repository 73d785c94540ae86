"""PySpark-native content-readiness and site-audit analytics for collections of pages."""

__version__ = "0.1.0"
