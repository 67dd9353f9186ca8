"""Spark jobs over API-gateway data: request logs, response caches, token pools, client keys."""
