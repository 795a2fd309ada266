"""Tables in the folder that driver and executors share."""

from maskwork.session import discard, shared_folder, written  # noqa: F401
