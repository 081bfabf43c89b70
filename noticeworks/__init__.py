"""Procurement-notice analytics on Spark DataFrames."""

from noticeworks.profile import LATIN_TEST, ZH_TENDER, Profile

__all__ = ["LATIN_TEST", "ZH_TENDER", "Profile"]
