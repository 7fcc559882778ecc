"""Rule-learning analytics on Spark: encode, evaluate, train and inspect weighted AND-rules as DataFrame plans."""

__version__ = "0.1.0"
