"""Evidence references of measurements as compact JSON (sorted keys, ASCII), cut to 400 characters. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import json_text, py_repr, py_round

MAX_REF, MAX_DETAIL = 400, 80


def _value(x: Column) -> Column:
    return F.coalesce(py_repr(x), F.lit("null"))


def change_ref(kind="kind", status="status", magnitude="magnitude", earlier="earlier", later="later", regions="regions", detail="detail") -> Column:
    """A visual change as its reference: as many regions as fit, largest first, and how many were left out."""
    boxes = F.coalesce(F.transform(regions, lambda r: F.concat(F.lit("["), F.array_join(F.array(*[py_repr(py_round(r[c], 4)) for c in ("x1", "y1", "x2", "y2")]), ","), F.lit("]"))), F.expr("cast(array() as array<string>)"))
    said = F.coalesce(F.left(F.col(detail), F.lit(MAX_DETAIL)), F.lit(""))
    head = F.concat(F.lit('{"compared":['), _value(F.col(earlier)), F.lit(","), _value(F.col(later)), F.lit("]"), F.when(said != "", F.concat(F.lit(',"detail":'), json_text(said))).otherwise(""))
    head = F.concat(head, F.lit(',"kind":'), json_text(kind), F.lit(',"magnitude":'), _value(py_round(magnitude, 4)), F.lit(',"regions":['))
    tail = F.concat(F.lit(',"status":'), json_text(status), F.lit("}"))

    def text(n: Column) -> Column:
        omitted = F.when(n < F.size(boxes), F.concat(F.lit(',"regions_omitted":'), (F.size(boxes) - n).cast("string"))).otherwise("")
        return F.concat(head, F.array_join(F.slice(boxes, 1, n), ","), F.lit("]"), omitted, tail)

    every = F.transform(F.sequence(F.size(boxes), F.lit(0), F.lit(-1)), text)
    return F.coalesce(F.get(F.filter(every, lambda x: F.length(x) <= MAX_REF), F.lit(0)), text(F.lit(0)))


def cursor_ref(state="motion_state", direction="direction_deg", speed="mean_speed_norm", basis="basis") -> Column:
    """A movement segment as its reference, nulls kept."""
    return F.concat(F.lit('{"basis":'), json_text(basis), F.lit(',"direction_deg":'), _value(py_round(direction, 2)), F.lit(',"speed_norm":'), _value(py_round(speed, 4)), F.lit(',"state":'), json_text(state), F.lit("}"))
