"""Sinks: nodes to Markdown, HTML, JSON and DOCX, one document to a row."""

from .render import render_documents, save_documents

__all__ = ["render_documents", "save_documents"]
