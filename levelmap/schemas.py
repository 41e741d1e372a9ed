"""Table schemas, the slot dimension and the calculation parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from levelmap import fixed


@dataclass(frozen=True)
class Params:
    """Calculation parameters used where a sheet row does not carry its own."""

    tol: float = fixed.DEFAULT_TOL
    buf: float = fixed.DEFAULT_BUF
    pin_narrow: float = fixed.DEFAULT_PIN_NARROW
    pin_wide: float = fixed.DEFAULT_PIN_WIDE


@dataclass(frozen=True)
class Slot:
    """One of the 25 places for a price on a level sheet.

    ``slot`` is the place in the list and decides the order of equal prices.
    ``source`` and ``label`` are None where the sheet's ``label_col`` supplies them.
    """

    slot: int
    family: str
    price_col: str
    size_col: str | None = None
    label_col: str | None = None
    source: str | None = None
    label: str | None = None


def _slots() -> tuple[Slot, ...]:
    rows: list[dict] = []
    for family, prefix, source in (("green", "g", fixed.SOURCE_GREEN), ("red", "r", fixed.SOURCE_RED)):
        for i in range(1, 5):
            rows.append(
                dict(family=family, price_col=f"{prefix}{i}p", size_col=f"{prefix}{i}s", source=source)
            )
    for column, source, label in fixed.NAMED_LEVELS:
        rows.append(dict(family="named", price_col=column, source=source, label=label))
    for i in range(1, len(fixed.GENERIC_LABELS) + 1):
        rows.append(dict(family="generic", price_col=f"gx{i}p", label_col=f"gx{i}l"))
    for i in range(1, len(fixed.CORRELATED_LABELS) + 1):
        rows.append(dict(family="correlated", price_col=f"qq{i}p", label_col=f"qq{i}l"))
    rows.append(
        dict(
            family="pivot",
            price_col="zero_gamma",
            source=fixed.SOURCE_ZERO_GAMMA,
            label=fixed.LABEL_ZERO_GAMMA,
        )
    )
    return tuple(Slot(slot=i, **row) for i, row in enumerate(rows))


SLOTS = _slots()
NODES = tuple(s for s in SLOTS if s.family in ("green", "red"))

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

TICK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("px", T.DoubleType()),
    ]
)

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("ticks", T.LongType()),
    ]
)


def sheet_defaults(params: Params = Params()) -> dict[str, tuple[str, object]]:
    """Every sheet field with its SQL type and default, in sheet order."""
    fields: dict[str, tuple[str, object]] = {
        "net_gex_pos": ("boolean", True),
        "zero_gamma": ("double", 0.0),
        "max_change": ("string", fixed.MAX_CHANGE_NEUTRAL),
    }
    for slot in SLOTS:
        fields.setdefault(slot.price_col, ("double", 0.0))
        if slot.size_col:
            fields[slot.size_col] = ("double", 0.0)
        if slot.label_col:
            fields[slot.label_col] = ("string", default_label(slot))
    for name in ("tol", "buf", "pin_narrow", "pin_wide"):
        fields[name] = ("double", getattr(params, name))
    return fields


def default_label(slot: Slot) -> str:
    """Label of a generic or correlated slot that the operator left unnamed."""
    names = fixed.GENERIC_LABELS if slot.family == "generic" else fixed.CORRELATED_LABELS
    first = next(s.slot for s in SLOTS if s.family == slot.family)
    return names[slot.slot - first]


SHEET_KEYS = ("symbol", "session_date")

_TYPES = {"boolean": T.BooleanType(), "double": T.DoubleType(), "string": T.StringType()}

SHEET_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("session_date", T.DateType())]
    + [T.StructField(name, _TYPES[sql]) for name, (sql, _) in sheet_defaults().items()]
)
