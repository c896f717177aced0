"""quire: fleet-wide analysis of BI workbook documents as Spark jobs."""

__version__ = "0.1.0"
