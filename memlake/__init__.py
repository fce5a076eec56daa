"""memlake: build, search and maintain a knowledge base as Spark jobs over tables and streams."""

__version__ = "0.1.0"
