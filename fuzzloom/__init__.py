"""fuzzloom: fuzzy cognitive maps and large-table data preparation as Spark plans."""

__version__ = "0.1.0"
