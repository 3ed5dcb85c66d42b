"""Registered queries; importing the package registers all of them."""

from . import admin, board, cards, catalog, discovery, facts, fields, legacy, links, pages, prose, signals, streams, subjects, tables, wording, workbooks  # noqa: F401
