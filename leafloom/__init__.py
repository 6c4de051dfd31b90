"""Web pages as relations: parse HTML once into nodes, query the nodes with DataFrames."""

__version__ = "0.1.0"
