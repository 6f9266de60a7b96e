"""Strandline: access-redundancy analytics as Spark plans and partition-parallel kernels."""
