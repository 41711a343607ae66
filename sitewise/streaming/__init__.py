"""The job log as a stream."""
