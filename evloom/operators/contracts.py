"""Contract rules as boolean columns: validate() splits rows into good ones and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
EVIDENCE_KINDS = ("transcript", "frame", "pointer", "vision", "visual_change", "cursor_track")
POINTER_STATUS = ("detected", "not_detected", "uncertain")
CHANGE_STATUS = ("detected", "not_detected", "unavailable")
VISION_STATUS = ("ok", "low_information", "failed", "unavailable")
CLAIM_STATUS = ("observed", "inferred", "unavailable", "conflicting")
NATURES = ("observed", "inferred", "unavailable")


def _in(col: str, values) -> str:
    return f"coalesce({col} in ({', '.join(repr(v) for v in values)}), false)"


def finite(x: str) -> str:
    return f"({x} is not null and not isnan({x}) and abs({x}) < double('Infinity'))"


UNIT = "({0} is null or ({0} >= 0 and {0} <= 1 and not isnan({0})))"

# table -> rule name -> SQL that holds for good rows
RULES: dict[str, dict[str, str]] = {
    "segment": {"segment_order": "end_sec >= start_sec", "segment_finite": f"{finite('start_sec')} and {finite('end_sec')}"},
    "evidence": {"evidence_kind": _in("kind", EVIDENCE_KINDS), "evidence_confidence": UNIT.format("confidence"), "evidence_span": "end_ts is null or end_ts >= ts"},
    "pointer": {"pointer_status": _in("status", POINTER_STATUS), "pointer_position": "status = 'not_detected' or (x is not null and y is not null)"},
    "cursor_segment": {
        "cursor_state": _in("motion_state", ("moving", "uncertain")),
        "cursor_span": "end_sec >= start_sec",
        "cursor_basis": "length(coalesce(basis, '')) > 0",
        "cursor_confidence": "confidence >= 0 and confidence <= 1",
        "cursor_direction": "direction_deg is null or (direction_deg >= 0 and direction_deg < 360)",
        "cursor_uncertain": "motion_state <> 'uncertain' or (direction_deg is null and mean_speed_norm is null and confidence = 0)",
        "cursor_moving": "motion_state <> 'moving' or coalesce(mean_speed_norm > 0, false)",
    },
    "region": {"region_box": "x1 >= 0 and y1 >= 0 and x2 <= 1 and y2 <= 1 and x2 > x1 and y2 > y1"},
    "visual_change": {
        "change_status": _in("status", CHANGE_STATUS),
        "change_order": "compared.later >= compared.earlier and timestamp_sec = compared.later",
        "change_magnitude": "(magnitude is null) = (status = 'unavailable')",
        "change_detected": "status <> 'detected' or size(regions) >= 1",
        "change_regions": "status = 'detected' or size(regions) = 0",
    },
    "vision": {"vision_status": _in("status", VISION_STATUS), "vision_confidence": UNIT.format("confidence")},
    "claim": {
        "claim_text": "length(trim(coalesce(text, ''))) > 0",
        "claim_status": _in("status", CLAIM_STATUS),
        "claim_confidence": "confidence >= 0 and confidence <= 1",
        "claim_evidence": "status = 'unavailable' or size(supporting_evidence) > 0",
        "claim_unavailable": "status <> 'unavailable' or confidence = 0",
        "claim_span": "timestamp_end_sec is null or timestamp_end_sec >= timestamp_sec",
        "claim_verification": "length(coalesce(verification, '')) > 0",
    },
    "inspection": {"inspection_time": f"{finite('start_sec')} and start_sec >= 0", "inspection_fps": f"fps is null or ({finite('fps')} and fps > 0)", "inspection_window": "end_sec is null or fps is not null"},
}


def violations(df: DataFrame, table: str, rules: tuple[str, ...] | None = None) -> DataFrame:
    """df with `broken`: the names of the rules that a row breaks, in rule order (unknown counts as broken); all rules of the table, or `rules`."""
    found = [F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in RULES[table].items() if rules is None or name in rules]
    return df.withColumn("broken", F.filter(F.array(*found), lambda x: x.isNotNull()))


def validate(df: DataFrame, table: str, strict: bool = False, rules: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with `rule`) by all rules of the table, or by `rules`; strict raises when a broken row is read."""
    marked = violations(df, table, rules)
    if strict:
        marked = marked.withColumn("broken", F.when(F.size("broken") > 0, F.raise_error(F.concat(F.lit(f"{table}: "), F.array_join("broken", ", ")))).otherwise(F.col("broken")))
        return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.lit(False))
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0).withColumn("rule", F.explode("broken")).drop("broken")
