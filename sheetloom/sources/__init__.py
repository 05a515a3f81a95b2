"""Manifests of sets, the JSON files they name, and result sinks."""
