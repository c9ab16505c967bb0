"""eventloom: public-event analytics over news and social posts as Spark DataFrame operators."""

__version__ = "0.1.0"
