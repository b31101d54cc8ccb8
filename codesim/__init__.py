"""codesim: a PySpark-native engine for source-code and text similarity."""

ENGINE_VERSION = "3.1.0"
