"""Import every query module so that the registry is full."""

from __future__ import annotations

from workload import clustering, labelling, payloads, reporting, requesting, running  # noqa: F401
from workload.registry import EXPECTED, QUERIES  # noqa: F401
