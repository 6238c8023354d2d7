"""Sources: each turns a column of documents into the table of nodes."""

from .parse import parse_documents, parse_files
from .registry import FORMATS, FormatSpec, detect_files, format_of

__all__ = ["FORMATS", "FormatSpec", "detect_files", "format_of", "parse_documents", "parse_files"]
