"""Readers and writers of layouts: JSON lines, annotated HTML, PPTX shapes and text, Arrow, CSV, listings."""

from deckframe.sources.files import arrow_rows, decks, json_lines, manifest_counts, write_csv, write_json_lines
from deckframe.sources.markup import html_elements, pptx_outline
from deckframe.sources.slides import corpus_files, listed, pptx_shapes

__all__ = ["arrow_rows", "corpus_files", "decks", "html_elements", "json_lines", "listed", "manifest_counts", "pptx_outline", "pptx_shapes", "write_csv", "write_json_lines"]
