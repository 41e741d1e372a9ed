"""Values that results are compared on: texts, thresholds, names and defaults.

Everything here is data. Nothing in this module is computed, so that a reader can
check it at a glance.
"""

from __future__ import annotations

# --- Fixed values: regime -----------------------------------------------------
MODE_FADE = "FADE EDGES"
MODE_FOLLOW = "FOLLOW MOMENTUM"
MODE_TRANSITION = "TRANSIZIONE"

NET_GEX_POSITIVE = "POSITIVO"
NET_GEX_NEGATIVE = "NEGATIVO"

MAX_CHANGE_NEUTRAL = "Neutro"
MAX_CHANGE_BEARISH = "Tutto rosso (bearish)"
MAX_CHANGE_BULLISH = "Tutto verde (bullish)"
MAX_CHANGE_OPTIONS = (MAX_CHANGE_NEUTRAL, MAX_CHANGE_BEARISH, MAX_CHANGE_BULLISH)

# --- Fixed values: parameters -------------------------------------------------
DEFAULT_TOL = 15.0
DEFAULT_BUF = 10.0
DEFAULT_PIN_NARROW = 300.0
DEFAULT_PIN_WIDE = 600.0

# --- Fixed values: the levels of a sheet, in list order -----------------------
SOURCE_GREEN = "GEXBot Green"
SOURCE_RED = "GEXBot Red"

# column, name used in a zone's source list, name used on the chart
NAMED_LEVELS = (
    ("mq_cr", "MQ Call Resistance", "MQ Call Res"),
    ("mq_ps", "MQ Put Support", "MQ Put Sup"),
    ("mq_hvl", "MQ HVL", "MQ HVL"),
    ("mq_cr0", "MQ CR 0DTE", "CR 0DTE"),
    ("mq_ps0", "MQ PS 0DTE", "PS 0DTE"),
    ("mq_gw0", "MQ GW 0DTE", "GW 0DTE"),
    ("mq_1dmin", "MQ 1D Min", "1D Min"),
    ("mq_1dmax", "MQ 1D Max", "1D Max"),
)
GENERIC_LABELS = ("GEX1", "GEX2", "GEX3", "GEX4", "GEX5")
CORRELATED_LABELS = ("QQQ1", "QQQ2", "QQQ3")
SOURCE_ZERO_GAMMA = "Zero Gamma"
LABEL_ZERO_GAMMA = "Zero Gamma / HVL"

# --- Fixed values: node labels and size classes -------------------------------
SIZE_CLASS_BOUNDS = (500, 1000, 2000)
TAG_FLIPPED_GREEN = " [⟳ RES]"
TAG_FLIPPED_RED = " [⟳ SUP]"

# --- Fixed values: pin --------------------------------------------------------
PIN_NARROW = "STRETTO"
PIN_NORMAL = "NORMALE"
PIN_WIDE = "AMPIO"
PIN_MARK = "📌"

# --- Fixed values: zones ------------------------------------------------------
STAR = "★"
MAX_STARS = 5
MIN_CONFLUENCE = 2
SOURCE_SEPARATOR = ", "

# --- Fixed values: number formats (java.text.DecimalFormat patterns) ----------
FORMAT_SIZE = "#,###"
FORMAT_ONE_DECIMAL = "#.#"
FORMAT_TWO_DECIMALS = "#.##"
FORMAT_WHOLE = "#"
FORMAT_SIGNED = "+#.#;-#.#"
FORMAT_PLAIN = "#.##########"
TEXT_UNSET = "n/a"

# --- Fixed values: summary row labels -----------------------------------------
# {brand} stands for the product tag, which the caller supplies.
SUMMARY_LABELS = (
    "MODE",
    "Net GEX",
    "Zero Gamma",
    "Max Change GEX",
    "Pin 0DTE",
    "{brand} Zones",
    "Target Speculare",
    "Spot",
)

# --- Fixed values: alerts -----------------------------------------------------
# kind, bias, title, message; {brand} as above.
ALERTS = (
    (
        "zone_entry_below",
        "long",
        "{brand} Zone — Entrata da sotto (LONG bias)",
        "[{brand}] Prezzo entrato in una {brand} Zone da sotto — possibile "
        "supporto/rimbalzo. Controlla rating e fonti sul grafico.",
    ),
    (
        "zone_entry_above",
        "short",
        "{brand} Zone — Entrata da sopra (SHORT bias)",
        "[{brand}] Prezzo entrato in una {brand} Zone da sopra — possibile "
        "resistenza/rigetto. Controlla rating e fonti sul grafico.",
    ),
    (
        "node_flip",
        "role change",
        "{brand} — Flip livello GEXBot (rottura con momentum)",
        "[{brand}] Un nodo GEXBot ha eseguito il flip! Il livello ha cambiato ruolo. "
        "Verifica il grafico per il nodo interessato.",
    ),
    (
        "pin_break_up",
        "long",
        "{brand} — Rottura Pin 0DTE superiore (Call Resistance 0DTE)",
        "[{brand}] Close oltre Call Resistance 0DTE + buffer. Potenziale breakout "
        "rialzista del pin.",
    ),
    (
        "pin_break_down",
        "short",
        "{brand} — Rottura Pin 0DTE inferiore (Put Support 0DTE)",
        "[{brand}] Close sotto Put Support 0DTE - buffer. Potenziale breakdown "
        "ribassista del pin.",
    ),
)
DEFAULT_BRAND = "LEVELMAP"
