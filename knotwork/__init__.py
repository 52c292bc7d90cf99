"""knotwork: a PySpark-native engine for knowledge graphs taken from papers, figures and source code."""
