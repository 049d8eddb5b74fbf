"""Stateful processing of live sessions."""
