"""Readers and writers around a project: manifests, config, git, files."""
