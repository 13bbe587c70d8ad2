"""Kernels: named finance functions as Spark SQL expressions."""
