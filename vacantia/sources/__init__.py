"""Landed payloads, source adapters, search queries and configuration inputs."""
