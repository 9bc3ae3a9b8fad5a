"""Crawl surfaces, page classification and listing pages."""
