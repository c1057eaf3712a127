"""Queries as text, trees and plans."""
