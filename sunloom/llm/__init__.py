"""Operators of a training-data pipeline: filter, clean, de-duplicate, mix, pack, shard."""
