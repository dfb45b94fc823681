"""Incremental forms of batch operators over unbounded inputs."""
