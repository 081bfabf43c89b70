"""Import every module that registers queries."""

from driver_checks import alerts, pages, planning, samples, search, tables  # noqa: F401
