"""Auction-stream analytics as DataFrame and Structured Streaming code."""
