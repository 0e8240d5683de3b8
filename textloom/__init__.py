"""textloom: text-corpus analytics for language-model data, expressed as Spark DataFrames."""

__version__ = "0.1.0"
