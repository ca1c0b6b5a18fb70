"""deckframe: a PySpark-native engine for page-layout inspection and judge evaluation."""

__version__ = "0.1.0"
