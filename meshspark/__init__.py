"""meshspark: a PySpark-native analytics engine for collections of polygon meshes."""

__version__ = "0.1.0"
