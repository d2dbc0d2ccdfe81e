"""Fields of a batch (global) and of its events (local)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import coerce


def resolve(attributes: Column, local: Column, allowed: list[str]) -> Column:
    """An event's fields as a map: its own, and of the batch's attributes the allowed ones that aren't null and that the event doesn't have. A field that is there with null is there."""
    listed = F.array(*map(F.lit, allowed)).cast("array<string>")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    own = F.coalesce(local, empty)
    added = F.map_filter(F.coalesce(attributes, empty), lambda k, v: v.isNotNull() & F.array_contains(listed, k) & ~F.map_contains_key(own, k))
    return F.map_concat(added, own)  # no key is in both, so no policy for repeated keys is needed


def local_fields(fields: Column, projected: list[str] | None = None) -> Column:
    """The fields flagged for projection (none named: all)."""
    if projected is None:
        return fields
    listed = F.array(*map(F.lit, projected)).cast("array<string>")
    return F.map_filter(fields, lambda k, _: F.array_contains(listed, k))


def field_of(star: Column, name: str) -> Column:
    """One field of a map, null if it isn't there."""
    return F.try_element_at(star, F.lit(name))


def explode_events(buffers: DataFrame, allowed: dict[str, list[str]], attrs: str = "attrs", events: str = "events") -> DataFrame:
    """Buffers (attrs map, events array of (event, fields map)) as one row an event, with star: the resolved fields. allowed: attribute names by event; an event that isn't listed has none."""
    rows = buffers.select(*(c for c in buffers.columns if c != events), F.posexplode(events).alias("event_no", "_e")).select("*", F.col("_e.event").alias("event"), F.col("_e.fields").alias("_fields"))
    star = resolve(F.col(attrs), F.col("_fields"), [])
    for event, names in allowed.items():
        star = F.when(F.col("event") == event, resolve(F.col(attrs), F.col("_fields"), names)).otherwise(star)
    return rows.withColumn("star", star).drop("_e", "_fields", attrs)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """One row for each id and value column; the values must have one type."""
    return df.unpivot(ids, values, name, value)


def rows_from_cells(cells: DataFrame, types: dict[int, tuple[str, str]]) -> DataFrame:
    """A stream of cells (buffer_id, event_id, is_field, field_id, is_null, is_float, int_value, float_value, str_value) as one row an event.

    types: name and kind by field id. A buffer's attributes (event_id null) are given to each of its events that lacks the field.
    """
    def picked(of_event: bool) -> list[Column]:
        out = []
        for field_id, (name, kind) in types.items():
            # Either side is coerced apart, as integers that pass through a double lose their last bits.
            value = F.col("str_value") if kind == "string" else F.when(F.col("is_float"), coerce(F.col("float_value"), kind)).otherwise(coerce(F.col("int_value"), kind))
            mine = (F.col("field_id") == field_id) & (F.col("event_id").isNotNull() if of_event else F.col("event_id").isNull())
            out += [F.max(F.when(mine & ~F.col("is_null"), value)).alias(name), F.coalesce(F.bool_or(mine), F.lit(False)).alias(f"has_{name}")]
        return out

    events = cells.filter("event_id is not null").groupBy("buffer_id", "event_id").agg(*picked(True))
    shared = cells.filter("event_id is null").groupBy("buffer_id").agg(*picked(False))
    joined = events.alias("e").join(shared.alias("s"), "buffer_id", "left")
    resolved = [F.when(F.col(f"e.has_{n}"), F.col(f"e.{n}")).otherwise(F.col(f"s.{n}")).alias(n) for n, _ in types.values()]
    return joined.select("buffer_id", "event_id", *resolved)
