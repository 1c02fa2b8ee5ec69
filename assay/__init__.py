"""assay: dataset diagnostics as Spark DataFrame operators over whole tables."""

__version__ = "0.1.0"
