"""Readers of game rows and other inputs."""
