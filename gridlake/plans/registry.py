"""Every query of the library by its name."""

from __future__ import annotations

from gridlake.plans.common import Query


def all_queries() -> dict[str, Query]:
    from gridlake.plans import image_queries

    return image_queries.Q
