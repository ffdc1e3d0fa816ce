"""Readers, writers and durable work folders."""
from tallyflow.sources.flows import profile, read_flows, read_trace, write_best, write_trace  # noqa: F401
from tallyflow.sources.storage import durable, work_path  # noqa: F401
