"""vocabspark: Spark-native data work around open-vocabulary labelling."""

__version__ = "0.1.0"
