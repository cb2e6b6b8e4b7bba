"""The public part of a manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUBLIC = ("token", "kind", "label")  # fixed value


def public_manifest(items: Column) -> Column:
    """Only the public keys of each item, whatever else a caller added."""
    return F.transform(items, lambda i: F.struct(*[i[k].alias(k) for k in PUBLIC]))
