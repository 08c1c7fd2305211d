"""Intermediate tables of the training-data operators; they live where those of the engine do."""

from noticelake.sources.scratch import clear, shared_dir, stored

__all__ = ["clear", "shared_dir", "stored"]
