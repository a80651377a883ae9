"""Readers for semi-structured inputs."""
