"""Token-id array functions (pad, trim, mask, strip)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_tokens(ids: Column, length: int, pad_id: int) -> Column:
    """Tokens padded (or cut) to `length`."""
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id).cast("int"), length))
    return F.slice(padded, 1, length)


def pad_mask(ids: Column, pad_id: int, end_id: int | None = None) -> Column:
    """True at padding. Where end and pad share an id, the first such token is the end, not padding."""
    if end_id is not None and end_id == pad_id:
        first = F.array_position(ids, F.lit(pad_id).cast("int"))
        return F.transform(ids, lambda _, i: (first > 0) & (i >= first))
    return F.transform(ids, lambda t: t == F.lit(pad_id))


def strip_tokens(ids: Column, start_id: int | None, end_id: int | None, pad_id: int) -> Column:
    """The noun's own tokens: no start token, nothing from the first end or pad token on."""
    if start_id is not None:
        ids = F.when(F.get(ids, F.lit(0)) == start_id, F.slice(ids, F.lit(2), F.greatest(F.size(ids), F.lit(1)))).otherwise(ids)
    stops = [F.array_position(ids, F.lit(s).cast("int")) for s in {end_id, pad_id} - {None}]
    stops = [F.when(s > 0, s) for s in stops]
    stop = F.coalesce(F.least(*stops) if len(stops) > 1 else stops[0], F.size(ids).cast("long") + 1)
    return F.slice(ids, F.lit(1), (stop - 1).cast("int"))


def trim_pad_columns(ids: Column, pad_id: int) -> Column:
    """Row without its trailing padding."""
    last = F.size(ids) - F.coalesce(
        F.array_max(F.transform(ids, lambda t, i: F.when(t != F.lit(pad_id), i + 1))), F.lit(0)
    )
    return F.slice(ids, F.lit(1), F.size(ids) - last)


def is_monotone(flags: Column) -> Column:
    """True when a boolean array never goes back to false."""
    return F.size(F.filter(F.transform(flags, lambda f, i: (~f) & F.coalesce(F.get(flags, i - 1), F.lit(False))), lambda x: x)) == 0


def prefix_equal(a: Column, b: Column) -> Column:
    """Per position, whether both arrays agree there and everywhere before."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.transform(same, lambda _, i: (first == 0) | (i + 1 < first))
