"""Label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(base: Column, overlay: Column) -> Column:
    """Union of two maps in which ``overlay`` wins; NULL when both are empty or NULL."""
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(base, empty), F.coalesce(overlay, empty)
    merged = F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)
    return F.when(F.size(merged) > 0, merged)


def labels_key(labels: Column) -> Column:
    """A map as sorted entries: groupable and comparable, unlike the map itself."""
    return F.sort_array(F.map_entries(labels))
