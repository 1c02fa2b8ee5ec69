"""Diagnostics over tables and over stored column profiles."""
