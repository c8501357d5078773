"""Readers of source trees and tables, and writers of artifacts."""
