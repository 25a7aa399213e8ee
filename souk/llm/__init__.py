"""Operators of a large-scale training-data pipeline (quality, dedup, decontamination, packing, archives)."""
