"""Equivalent SQL for DuckDB, written the direct way.

These statements do not share the shortcuts of the Spark side: sheets rank every tick,
clusters come from a recursive walk, previous closes from one window per symbol, and flips
from a latch over break rows. Agreement is therefore evidence and not a tautology.
"""

from __future__ import annotations

from levelmap import fixed
from levelmap.schemas import NODES, SLOTS, sheet_defaults


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return _text(value) if isinstance(value, str) else f"{value!r}::double"


def _default(name: str) -> str:
    return _literal(sheet_defaults()[name][1])


def _source(slot) -> str:
    return _default(slot.label_col) if slot.label_col else _text(slot.source)


def _label(slot) -> str:
    if slot.label_col:
        return _default(slot.label_col)
    return _text(slot.label) if slot.label else "null::varchar"


_SLOT_ROWS = ",\n    ".join(
    f"({s.slot}, {_text(s.family)}, {_source(s)}, {_label(s)})" for s in SLOTS
)
_SIZES = "[0, 250, 500, 750, 1000, 1500, 2000, 2500]"
_OPTIONS = "[" + ", ".join(_text(o) for o in fixed.MAX_CHANGE_OPTIONS) + "]"


def _pivot(slot) -> str:
    return f"coalesce(max(price) filter (slot = {slot.slot}), 0.0) as {slot.price_col}"


def _constant_fields() -> str:
    fields = []
    for s in SLOTS:
        if s.size_col:
            fields.append(f"{_SIZES}[{s.slot + 1}]::double as {s.size_col}")
        if s.label_col:
            fields.append(f"{_default(s.label_col)} as {s.label_col}")
    fields += [f"{_default(p)} as {p}" for p in ("tol", "buf", "pin_narrow", "pin_wide")]
    return ",\n    ".join(fields)


def _one_decimal(x: str) -> str:
    return f"regexp_replace(printf('%.1f', {x}), '\\.0$', '')"


def _two_decimals(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


_PIN_CLASS = (
    f"case when width < pin_narrow then {_text(fixed.PIN_NARROW)} "
    f"when width < pin_wide then {_text(fixed.PIN_NORMAL)} else {_text(fixed.PIN_WIDE)} end"
)

# name -> (tables it reads, text)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": (
        (),
        """
  select event_type as symbol, ts, event_id, ts::date as session_date,
    19000 + floor(value * 16) / 4 as px
  from events
  where event_type is not null and ts is not null and value is not null""",
    ),
    "bars": (
        ("ticks",),
        """
  select symbol, date_trunc('hour', ts)::timestamp as ts, date_trunc('hour', ts)::date as session_date,
    first(px order by ts, event_id) as open, max(px) as high, min(px) as low,
    last(px order by ts, event_id) as close, count(*) as ticks
  from ticks
  group by symbol, date_trunc('hour', ts)""",
    ),
    "slots": (
        (),
        f"""
  select * from (values
    {_SLOT_ROWS}) as t(slot, family, source, label)""",
    ),
    "ranked_ticks": (
        ("ticks",),
        """
  select symbol, session_date, px,
    row_number() over (partition by symbol, session_date order by px, event_id) as r,
    count(*) over (partition by symbol, session_date) as n
  from ticks""",
    ),
    "placed": (
        ("ranked_ticks",),
        """
  select symbol, (session_date + 1)::date as session_date, (k * 7 % 25)::integer as slot, px
  from ranked_ticks, range(25) as ks(k)
  where r = 1 + k * n // 25""",
    ),
    "levels": (
        ("placed", "slots"),
        f"""
  select symbol, session_date, slot, family, source, label,
    case when (slot + day(session_date)) % 7 = 0 then 0.0 else px end as price,
    case when slot < 8 then {_SIZES}[slot + 1]::double end as size_m
  from placed join slots using (slot)""",
    ),
    "active": (("levels",), "\n  select * from levels where price <> 0"),
    "sheet": (
        ("levels",),
        f"""
  select symbol, session_date,
    day(session_date) % 3 <> 0 as net_gex_pos,
    {_OPTIONS}[day(session_date) % 3 + 1] as max_change,
    true as max_change_ok,
    {", ".join(_pivot(s) for s in SLOTS)},
    {_constant_fields()}
  from levels
  group by symbol, session_date""",
    ),
    "ordered": (
        ("active",),
        """
  select symbol, session_date, slot, source, price,
    (row_number() over (partition by symbol, session_date order by price, slot))::integer as pos
  from active""",
    ),
    "walk": (
        ("ordered",),
        """
  select symbol, session_date, pos, price, source, price as anchor
  from ordered where pos = 1
  union all
  select o.symbol, o.session_date, o.pos, o.price, o.source,
    case when o.price - w.anchor <= 15 then w.anchor else o.price end
  from walk w join ordered o
    on o.symbol = w.symbol and o.session_date = w.session_date and o.pos = w.pos + 1""",
    ),
    "zones": (
        ("walk",),
        """
  select symbol, session_date,
    (row_number() over (partition by symbol, session_date order by start))::integer as zone_seq,
    start, center, n, sources, center - 7.5 as bot, center + 7.5 as top
  from (
    select symbol, session_date, anchor as start, sum(price order by pos) / count(*) as center,
      count(*)::integer as n, string_agg(source, ', ' order by pos) as sources
    from walk group by symbol, session_date, anchor
  ) where n >= 2""",
    ),
    "lagged": (
        ("bars",),
        """
  select symbol, session_date, ts, close,
    lag(close) over (partition by symbol order by ts) as prev_close
  from bars""",
    ),
    "last_bars": (
        ("bars",),
        """
  select symbol, session_date, ts, open, high, low, close, ticks from bars
  qualify row_number() over (partition by symbol, session_date order by ts desc) = 1""",
    ),
    "breaks": (
        ("bars", "active"),
        """
  select b.symbol, b.session_date, b.ts, v.slot, b.close, v.price,
    case when v.family = 'green' then b.close < v.price - 10 else b.close > v.price + 10 end as is_break
  from bars b join active v using (symbol, session_date)
  where v.slot < 8""",
    ),
    "latch": (
        ("breaks",),
        """
  select *,
    bool_or(is_break) over w as flipped,
    count(*) filter (is_break) over w as n_breaks
  from breaks
  window w as (partition by symbol, session_date, slot order by ts
    rows between unbounded preceding and current row)""",
    ),
    "flip_events": (
        ("latch",),
        """
  select symbol, session_date, slot, ts as flip_ts, close, price
  from latch where is_break and n_breaks = 1""",
    ),
    "bar_flip": (
        ("bars", "sheet", "flip_events"),
        """
  select b.symbol, b.session_date, b.ts, b.close,
    exists (select 1 from flip_events f
      where f.symbol = b.symbol and f.session_date = b.session_date and f.flip_ts = b.ts) as any_flip
  from bars b semi join sheet using (symbol, session_date)""",
    ),
    "entries": (
        ("lagged", "zones"),
        """
  select l.symbol, l.session_date, l.ts, z.zone_seq,
    case when l.prev_close < z.bot then 'below' else 'above' end as side,
    l.prev_close, l.close, z.bot, z.top
  from lagged l join zones z using (symbol, session_date)
  where l.close >= z.bot and l.close <= z.top and (l.prev_close < z.bot or l.prev_close > z.top)""",
    ),
    "bar_entry": (
        ("lagged", "sheet", "entries"),
        """
  select l.symbol, l.session_date, l.ts, l.close,
    coalesce(bool_or(e.side = 'below'), false) as from_below,
    coalesce(bool_or(e.side = 'above'), false) as from_above
  from lagged l semi join sheet using (symbol, session_date)
  left join entries e on e.symbol = l.symbol and e.ts = l.ts
  group by l.symbol, l.session_date, l.ts, l.close""",
    ),
    "pin_breaks": (
        ("bars", "sheet"),
        """
  select symbol, session_date, ts, 'up' as side, close, mq_cr0 + 10 as threshold
  from bars join sheet using (symbol, session_date)
  where mq_cr0 <> 0 and close > mq_cr0 + 10
  union all
  select symbol, session_date, ts, 'down', close, mq_ps0 - 10
  from bars join sheet using (symbol, session_date)
  where mq_ps0 <> 0 and close < mq_ps0 - 10""",
    ),
    "node_state": (
        ("latch", "active", "last_bars"),
        f"""
  select symbol, session_date, slot, price, size_m, flipped,
    case when (family = 'green') <> flipped then 'support' else 'resistance' end as role,
    (case when size_m <= 0 then 1 when size_m < 500 then 1 when size_m < 1000 then 2
      when size_m < 2000 then 3 else 4 end)::integer as width,
    case when family = 'green' then 'G' else 'R' end || (slot % 4 + 1)::varchar
      || case when size_m > 0 then ' $' || format('{{:,}}', size_m::bigint) || 'M' else '' end
      || case when not flipped then '' when family = 'green' then {_text(fixed.TAG_FLIPPED_GREEN)}
        else {_text(fixed.TAG_FLIPPED_RED)} end as label
  from latch join last_bars using (symbol, session_date, ts)
  join active using (symbol, session_date, slot, price)""",
    ),
    "zone_at_last": (
        ("zones", "last_bars"),
        """
  select z.*, b.close as last_close, case when z.center > b.close then 'above' else 'below' end as side
  from zones z join last_bars b using (symbol, session_date)""",
    ),
    "bar_sides": (
        ("bars", "sheet", "zones"),
        """
  select b.symbol, b.session_date, b.ts, b.close,
    count(*) filter (z.center > b.close)::integer as zones_above,
    count(*) filter (z.center <= b.close)::integer as zones_below
  from bars b semi join sheet using (symbol, session_date)
  left join zones z using (symbol, session_date)
  group by b.symbol, b.session_date, b.ts, b.close""",
    ),
    "side_counts": (
        ("bar_sides", "last_bars"),
        """
  select symbol, session_date, s.close as last_close, zones_above, zones_below
  from bar_sides s semi join last_bars using (symbol, session_date, ts)""",
    ),
    "zone_texts": (
        ("zones",),
        f"""
  select symbol, session_date, zone_seq, n,
    repeat({_text(fixed.STAR)}, greatest(1, least(n, 5))) as stars,
    repeat({_text(fixed.STAR)}, greatest(1, least(n, 5))) || '  ' || {_two_decimals("center")}
      || chr(10) || sources as label
  from zones""",
    ),
    "pins": (
        ("sheet",),
        f"""
  select symbol, session_date, mq_ps0, mq_cr0, width, mid,
    case when width is not null then {_PIN_CLASS} end as pin_class,
    {_text(fixed.PIN_MARK + " ")} || {_PIN_CLASS} || '  ' || {_one_decimal("width")} || ' pt' as box_text,
    coalesce({_PIN_CLASS} || ' (' || printf('%.0f', width) || ' pt)', 'n/a') as summary_text
  from (
    select *,
      case when mq_ps0 <> 0 and mq_cr0 <> 0 then mq_cr0 - mq_ps0 end as width,
      case when mq_ps0 <> 0 and mq_cr0 <> 0 then (mq_cr0 + mq_ps0) / 2 end as mid
    from sheet
  )""",
    ),
    "regime": (
        ("bars", "sheet"),
        f"""
  select symbol, session_date, ts, close, net_gex_pos, zero_gamma,
    case when net_gex_pos and close > zero_gamma then {_text(fixed.MODE_FADE)}
      when not net_gex_pos and close < zero_gamma then {_text(fixed.MODE_FOLLOW)}
      else {_text(fixed.MODE_TRANSITION)} end as mode,
    case when zero_gamma <> 0 then close - zero_gamma end as zg_distance,
    case when zero_gamma <> 0 then zero_gamma + (zero_gamma - close) end as mirror_target
  from bars join sheet using (symbol, session_date)""",
    ),
    "bar_snap": (
        ("regime", "sheet", "pins", "bar_sides"),
        f"""
  select r.symbol, r.session_date, r.ts, r.close as spot, r.mode,
    case when r.net_gex_pos then {_text(fixed.NET_GEX_POSITIVE)} else {_text(fixed.NET_GEX_NEGATIVE)} end
      as net_gex,
    r.zero_gamma, r.zg_distance,
    {_two_decimals("r.zero_gamma")} || '  (' || coalesce(
      case when r.zg_distance >= 0 then '+' else '' end || {_one_decimal("r.zg_distance")} || ' pt', 'n/a')
      || ')' as zg_text,
    s.max_change,
    case s.max_change when {_text(fixed.MAX_CHANGE_BULLISH)} then 'bullish'
      when {_text(fixed.MAX_CHANGE_BEARISH)} then 'bearish' else 'neutral' end as max_change_bias,
    p.width as pin_width, p.summary_text as pin_text, c.zones_above, c.zones_below,
    '▲ ' || c.zones_above::varchar || '  ▼ ' || c.zones_below::varchar as zones_text,
    r.mirror_target, coalesce({_two_decimals("r.mirror_target")}, 'n/a') as mirror_text,
    {_two_decimals("r.close")} as spot_text
  from regime r
  join sheet s using (symbol, session_date)
  join pins p using (symbol, session_date)
  join bar_sides c using (symbol, session_date, ts)""",
    ),
    "snap": (
        ("bar_snap", "last_bars"),
        "\n  select * from bar_snap semi join last_bars using (symbol, session_date, ts)",
    ),
}

_BIAS = (
    f"case max_change when {_text(fixed.MAX_CHANGE_BULLISH)} then 'bullish' "
    f"when {_text(fixed.MAX_CHANGE_BEARISH)} then 'bearish' else 'neutral' end"
)
_SHEET_FIELDS = "net_gex_pos, zero_gamma, max_change, mq_cr0, mq_ps0"


def _alert_rows(source: str, condition: str, kind: str) -> str:
    _, bias, title, message = next(a for a in fixed.ALERTS if a[0] == kind)
    brand = fixed.DEFAULT_BRAND
    return (
        f"select symbol, session_date, ts, {_text(kind)} as kind, {_text(bias)} as bias, close,\n"
        f"  {_text(title.format(brand=brand))} as title,\n"
        f"  {_text(message.format(brand=brand))} as message\n"
        f"from {source} where {condition}"
    )


_ALERTS = "\nunion all\n".join(
    _alert_rows(source, condition, kind)
    for source, condition, kind in (
        ("bar_entry", "from_below", "zone_entry_below"),
        ("bar_entry", "from_above", "zone_entry_above"),
        ("bar_flip", "any_flip", "node_flip"),
        ("pin_breaks", "side = 'up'", "pin_break_up"),
        ("pin_breaks", "side = 'down'", "pin_break_down"),
    )
)


def _summary_rows() -> str:
    values = ("mode", "net_gex", "zg_text", "max_change", "pin_text", "zones_text", "mirror_text", "spot_text")
    return "\nunion all\n".join(
        f"select symbol, session_date, {n} as row_no, "
        f"{_text(label.format(brand=fixed.DEFAULT_BRAND))} as label, {value} as value from snap"
        for n, (label, value) in enumerate(zip(fixed.SUMMARY_LABELS, values), start=1)
    )


_ANNOTATIONS = """
select symbol, session_date, 'node' as kind, slot as seq, price, null::double as bot, null::double as top,
  label, role, width as size_class
from node_state
union all
select a.symbol, a.session_date, a.family, a.slot, a.price, null, null, a.label, null, null
from active a semi join last_bars using (symbol, session_date) where a.slot >= 8
union all
select p.symbol, p.session_date, 'pin', 0, p.mid, p.mq_ps0, p.mq_cr0, p.box_text, null, null
from pins p semi join last_bars using (symbol, session_date) where p.width is not null
union all
select z.symbol, z.session_date, 'zone', z.zone_seq, z.center, z.bot, z.top, t.label, z.side, null
from zone_at_last z join zone_texts t using (symbol, session_date, zone_seq)"""

# query -> (tables it reads, statement)
_QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars_1h": (("bars",), "select * from bars"),
    "bars_local": (
        ("ticks",),
        """
select symbol, (session_date::timestamp at time zone 'America/New_York') at time zone 'UTC' as ts, session_date,
  first(px order by t, event_id) as open, max(px) as high, min(px) as low,
  last(px order by t, event_id) as close, count(*) as ticks
from (
  select symbol, ts as t, event_id, px, ((ts at time zone 'UTC') at time zone 'America/New_York')::date as session_date
  from ticks)
group by symbol, session_date""",
    ),
    "sheet_defaults": (("sheet",), "select * from sheet"),
    "sheet_static": (
        ("bars", "sheet"),
        f"""
select b.symbol, b.ts, b.session_date, s.session_date as sheet_date, b.close, {_SHEET_FIELDS}
from bars b join (
  select * from sheet qualify row_number() over (partition by symbol order by session_date desc) = 1
) s on s.symbol = b.symbol""",
    ),
    "sheet_by_session": (
        ("bars", "sheet"),
        f"""
select symbol, ts, session_date, session_date as sheet_date, close, {_SHEET_FIELDS}
from bars join sheet using (symbol, session_date)""",
    ),
    "sheet_asof": (
        ("bars", "sheet"),
        f"""
select b.symbol, b.ts, b.session_date, s.session_date as sheet_date, b.close, {_SHEET_FIELDS}
from bars b asof join sheet s on s.symbol = b.symbol and s.session_date <= b.session_date""",
    ),
    "level_unpivot": (
        ("levels",),
        "select symbol, session_date, slot, family, source, price, size_m from levels",
    ),
    "active_levels": (
        ("active",),
        "select symbol, session_date, slot, family, source, price, size_m from active",
    ),
    "level_order": (("ordered",), "select symbol, session_date, pos, slot, source, price from ordered"),
    "regime_mode": (
        ("regime",),
        "select symbol, ts, session_date, close, net_gex_pos, zero_gamma, mode from regime",
    ),
    "zg_distance": (("regime",), "select symbol, ts, session_date, close, zero_gamma, zg_distance from regime"),
    "mirror_target": (
        ("regime",),
        "select symbol, ts, session_date, close, zero_gamma, mirror_target from regime",
    ),
    "max_change_bias": (("sheet",), f"select symbol, session_date, max_change, {_BIAS} as bias from sheet"),
    "prev_close": (("lagged",), "select symbol, ts, session_date, close, prev_close from lagged"),
    "session_reset_dom": (
        ("bars",),
        """
select symbol, ts, session_date, is_new,
  (count(*) filter (is_new) over (partition by symbol order by ts))::bigint as session_seq
from (
  select symbol, ts, session_date,
    coalesce(day(ts) <> lag(day(ts)) over (partition by symbol order by ts), true) as is_new
  from bars
)""",
    ),
    "last_bar": (("last_bars",), "select * from last_bars"),
    "node_break": (("breaks",), "select * from breaks"),
    "node_flip_state": (("latch",), "select symbol, session_date, ts, slot, price, flipped from latch"),
    "node_flip_event": (("flip_events",), "select * from flip_events"),
    "any_flip": (("bar_flip",), "select symbol, session_date, ts, any_flip from bar_flip"),
    "node_width": (("node_state",), "select symbol, session_date, slot, size_m, width from node_state"),
    "node_role": (("node_state",), "select symbol, session_date, slot, flipped, role from node_state"),
    "node_label": (("node_state",), "select symbol, session_date, slot, price, label from node_state"),
    "zone_clusters": (("zones",), "select symbol, session_date, zone_seq, start, center, n, sources from zones"),
    "zone_bounds": (("zones",), "select symbol, session_date, zone_seq, center, bot, top from zones"),
    "zone_stars": (("zone_texts",), "select symbol, session_date, zone_seq, n, stars from zone_texts"),
    "zone_label": (("zone_texts",), "select symbol, session_date, zone_seq, label from zone_texts"),
    "zone_side": (
        ("zone_at_last",),
        "select symbol, session_date, zone_seq, center, last_close, side from zone_at_last",
    ),
    "zone_counts": (("side_counts",), "select * from side_counts"),
    "zone_entry": (("entries",), "select * from entries"),
    "zone_entry_any": (("bar_entry",), "select symbol, session_date, ts, from_below, from_above from bar_entry"),
    "zone_entry_intrabar": (
        ("ticks", "lagged", "zones"),
        """
select symbol, session_date, ts, side, tick_ts, event_id, px
from (
  select l.symbol, l.session_date, l.ts, t.ts as tick_ts, t.event_id, t.px,
    case when l.prev_close < z.bot then 'below' else 'above' end as side
  from ticks t
  join lagged l on l.symbol = t.symbol and l.ts = date_trunc('hour', t.ts)
  join zones z on z.symbol = l.symbol and z.session_date = l.session_date
  where t.px >= z.bot and t.px <= z.top and (l.prev_close < z.bot or l.prev_close > z.top)
)
qualify row_number() over (partition by symbol, ts, side order by tick_ts, event_id) = 1""",
    ),
    "zone_touch_count": (
        ("zones", "entries"),
        """
select z.symbol, z.session_date, z.zone_seq, count(e.ts) as touches
from zones z left join entries e using (symbol, session_date, zone_seq)
group by z.symbol, z.session_date, z.zone_seq""",
    ),
    "pin_box": (
        ("pins",),
        "select symbol, session_date, mq_ps0, mq_cr0, width, mid from pins where width is not null",
    ),
    "pin_class": (
        ("pins",),
        "select symbol, session_date, width, pin_class from pins where width is not null",
    ),
    "pin_text": (
        ("pins",),
        "select symbol, session_date, case when width is not null then box_text end as box_text, "
        "case when width is not null then summary_text else 'n/a' end as summary_text from pins",
    ),
    "pin_break": (("pin_breaks",), "select * from pin_breaks"),
    "alerts": (("bar_entry", "bar_flip", "pin_breaks"), _ALERTS),
    "snapshot": (("snap",), "select * from snap"),
    "snapshot_rows": (("snap",), _summary_rows()),
    "annotations": (("node_state", "active", "last_bars", "pins", "zone_at_last", "zone_texts"), _ANNOTATIONS),
}

# Bars that a watermark without delay has closed at the end of the data.
_CLOSED = "ts + interval 1 hour <= (select max(ts) from ticks)"
_QUERIES |= {
    "stream_bars": (("ticks", "bars"), f"select * from bars where {_CLOSED}"),
    "stream_alerts": (
        ("ticks", "bar_entry", "bar_flip", "pin_breaks"),
        f"select * from ({_ALERTS}) where {_CLOSED}",
    ),
    "stream_forming": (("bar_snap",), "select * from bar_snap"),
}
_QUERIES["stream_zone_entry"] = _QUERIES["zone_entry_intrabar"]




def _entry_events(source: str) -> str:
    def text(kind: str, field: int) -> str:
        return _text(next(a for a in fixed.ALERTS if a[0] == kind)[field].format(brand=fixed.DEFAULT_BRAND))

    def side(field: int) -> str:
        return f"case side when 'below' then {text('zone_entry_below', field)} else {text('zone_entry_above', field)} end"

    return f"""
select symbol, session_date, ts, 'intrabar_zone_entry_' || side as kind, {side(1)} as bias, px as close, tick_ts, event_id,
  {side(2)} as title, {side(3)} as message
from ({source})"""


_INTRABAR = _QUERIES["zone_entry_intrabar"][1]
_FEED_TABLES = ("ticks", "lagged", "zones", "bar_entry", "bar_flip", "pin_breaks")


def _feed(condition: str) -> str:
    return f"""
select symbol, session_date, ts, kind, bias, close, null::timestamp as tick_ts, null::bigint as event_id, title, message
from ({_ALERTS}) where {condition}
union all
{_entry_events(_INTRABAR)}"""


_QUERIES |= {
    "alert_feed": (_FEED_TABLES, _feed("true")),
    "stream_restated": (_FEED_TABLES, _feed("true")),
    "stream_alert_feed": (_FEED_TABLES, _feed(_CLOSED)),
    "stream_touch_count": (
        ("ticks", "bars", "zones", "entries"),
        f"""
select z.symbol, z.session_date, z.zone_seq, count(e.ts) as touches
from zones z left join (select * from entries where {_CLOSED}) e using (symbol, session_date, zone_seq)
where z.session_date in (select session_date from bars where {_CLOSED})
group by z.symbol, z.session_date, z.zone_seq""",
    ),
    "stream_alerts_asof": (_FEED_TABLES, _feed(_CLOSED)),
}
# Sheets of every third day, each in force until the next one.
_OVERRIDES = {
    "stream_alerts_asof": {
        "levels": (
            ("bars", *_CTES["levels"][0]),
            f"""
  select b.symbol, b.session_date, slot, family, source, label, price, size_m
  from (
    select symbol, d.session_date, max(s.session_date) as sheet_date
    from (select distinct symbol, session_date from bars) d
    join (select distinct symbol, session_date from placed where day(session_date) % 3 = 1) s using (symbol)
    where s.session_date <= d.session_date group by symbol, d.session_date) b
  join ({_CTES["levels"][1]}) l on l.symbol = b.symbol and l.session_date = b.sheet_date""",
        )
    }
}


def _needed(names: tuple[str, ...], tables: dict) -> set[str]:
    found: set[str] = set()
    for name in names:
        found |= {name} | _needed(tables[name][0], tables)
    return found


def with_tables(names: tuple[str, ...], statement: str, overrides: dict | None = None) -> str:
    """The statement preceded by the common tables it needs, in order of definition."""
    tables = _CTES | (overrides or {})
    wanted = _needed(names, tables)
    texts = ",\n".join(f"{name} as ({text})" for name, (_, text) in tables.items() if name in wanted)
    return f"with recursive {texts}\n{statement.strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(tables, statement, _OVERRIDES.get(name)) for name, (tables, statement) in _QUERIES.items()}
