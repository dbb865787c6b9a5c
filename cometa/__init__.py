"""cometa: audit and classify free-text field comments on Spark.

Every operator is a function ``DataFrame -> DataFrame`` or a builder
returning a ``Column``; nothing collects data on the driver beyond
small, size-checked metadata (class lists, bounded vocabularies).
"""

__version__ = "0.1.0"
