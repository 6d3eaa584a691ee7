"""DuckDB SQL for the registered queries, written on its own terms.

Addresses are classified by number ranges and ranges matched by shifts here, where the Spark
side uses pattern tables and prefix joins, so that the two check each other.
"""

from __future__ import annotations

from emberwatch.plans.tables import COLON_FORMS

AS_OF = "2024-02-15T12:00:00+00:00"
YEAR = 2024
READING_TIMES = [
    "2024-01-02 06:01:00", "2024-01-20 00:00:00", "2024-01-20 13:37:00", "2024-01-31 23:59:00",
    "2030-01-01 00:00:00",
]

W = r"[\p{L}\p{N}_]"
S = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
N = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"

ALERTS = r"""
b as (select event_id, ts, user_id, event_type,
        cast(json_extract_string(props, '$.k') as bigint) as k from events),
a as (select *, cast((event_id * 7) % 16 as int) as level,
  case user_id % 4 when 0 then concat('192.168.1.', cast(user_id % 250 + 1 as varchar))
    when 1 then concat('10.0.0.', cast(user_id % 250 + 1 as varchar))
    when 2 then concat('45.33.', cast(user_id % 200 as varchar), '.', cast(k + 1 as varchar))
    else concat('198.51.100.', cast(user_id % 250 + 1 as varchar)) end as src,
  case k % 5 when 0 then null when 1 then concat('10.0.0.', cast(k + 1 as varchar))
    when 2 then concat('192.168.1.1', cast(k % 10 as varchar)) when 3 then '172.16.0.10'
    else concat('8.8.4.', cast(k + 1 as varchar)) end as dst,
  case k % 8 when 0 then '22' when 1 then '80' when 2 then '90' when 3 then '443'
    when 4 then '3306' when 5 then '8080' when 6 then '0' else null end as dstport,
  concat('u', cast(user_id as varchar)) as u from b),
alerts as (select event_id as alert_id, ts, level, concat('r', cast(level as varchar)) as rule_id,
  event_type, case when k % 3 = 0 then src else null end as srcip, dstport,
  case when k % 7 = 0 then '10.0.0.9' else null end as agent_ip,
  case event_type
    when 'error' then concat(strftime(ts, '%b %d %H:%M:%S'),
      ' host sshd[1]: Failed password for ', u, ' from ', src, ' port 22 ssh2',
      case when dst is null then '' else concat(' to ', dst) end)
    when 'signup' then concat('date=', strftime(ts, '%Y-%m-%d'), ' time=',
      strftime(ts, '%H:%M:%S'), ' account=', u, ' srcip=', src,
      case when dst is null then '' else concat(' dstip=', dst) end)
    when 'purchase' then concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' session opened for user ', u,
      ' by (uid=0) from ', src, case when dst is null then '' else concat(' to ', dst) end)
    when 'view' then concat('[', strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' ] [client ', src,
      '] user ', u, ': GET /x')
    else case when k % 10 = 0 then '' else concat('At ', strftime(ts, '%H:%M:%S'), ' ',
      strftime(ts, '%d/%m/%Y'), ' (', u, '@host) ', src,
      case when dst is null then '' else concat(' -> ', dst) end) end
  end as full_log from a)"""


# The shape of an address in a text, and the shapes of a user name in their order.
def ip_at(text: str, n: int) -> str:
    pattern = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
    return f"list_extract(regexp_extract_all({text}, '{pattern}', 1), {n})"


def hit(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def user(text: str) -> str:
    shapes = [
        rf"account=({N}+)", rf"for user ({N}+)", rf"for ({W}+){S}+from{S}+\d",
        rf"\] user ({W}+):", rf"user ({W}+)", r"\(([^)]+@[^)]+)\)",
        rf"by \(uid=\d+\)[^\n]*?user ({N}+)",
    ]
    return "coalesce(" + ", ".join(hit(text, s) for s in shapes) + ")"


def timestamp(text: str) -> str:
    def squeeze(c: str) -> str:
        return f"regexp_replace({c}, '{S}+', ' ', 'g')"

    def parsed(c: str, form: str) -> str:
        t = f"try_strptime({c}, '{form}')"
        return f"case when year({t}) >= 1 then {t} end"

    def dated(c: str, form: str) -> str:
        t = parsed(c, form)
        return f"case when year({t}) = 1900 then {t} + to_years({YEAR - 1900}) else {t} end"

    day = rf"({W}{{3}}{S}+\d{{1,2}}{S}+\d{{2}}:\d{{2}}:\d{{2}}{S}+\d{{4}})"
    syslog = rf"([A-Z][a-z]{{2}}{S}+\d{{1,2}}{S}+\d{{2}}:\d{{2}}:\d{{2}})"
    keyed = rf"date=(\d{{4}}-\d{{2}}-\d{{2}}){S}+time=(\d{{2}}:\d{{2}}:\d{{2}})"
    at = rf"At{S}+(\d{{2}}:\d{{2}}:\d{{2}}){S}+(\d{{2}}/\d{{2}}/\d{{4}})"
    dotted = rf"\[Time{S}+(\d{{4}}\.\d{{2}}\.\d{{2}}{S}+\d{{2}}:\d{{2}}:\d{{2}})"
    plain = rf"(\d{{4}}-\d{{2}}-\d{{2}}{S}+\d{{2}}:\d{{2}}:\d{{2}})"
    access = rf"\[(\d{{2}}/{W}{{3}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}})"
    tries = [
        dated(hit(text, r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"), "%Y-%m-%dT%H:%M:%S"),
        parsed(f"({hit(text, keyed)} || ' ' || {hit(text, keyed, 2)})", "%Y-%m-%d %H:%M:%S"),
        dated(f"('1900 ' || {squeeze(hit(text, syslog))})", "%Y %b %d %H:%M:%S"),
        dated(squeeze(hit(text, rf"\[(?:{W}{{3}}{S}+)?{day}\]")), "%b %d %H:%M:%S %Y"),
        dated(squeeze(hit(text, dotted)), "%Y.%m.%d %H:%M:%S"),
        dated(f"('1900-01-01 ' || {hit(text, rf'^([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}){S}')})",
              "%Y-%m-%d %H:%M:%S"),
        dated(squeeze(hit(text, plain)), "%Y-%m-%d %H:%M:%S"),
        parsed(f"({hit(text, at, 2)} || ' ' || {hit(text, at)})", "%d/%m/%Y %H:%M:%S"),
        dated(hit(text, access), "%d/%b/%Y:%H:%M:%S"),
    ]
    found = "coalesce(" + ", ".join(tries) + ")"
    return f"coalesce(strftime({found}, '%Y-%m-%dT%H:%M:%S+00:00'), '{AS_OF}')"


NORMALIZED = f"""{ALERTS},
normalized as (select alert_id, ts,
  coalesce(nullif(srcip, ''), {ip_at('full_log', 1)}) as source_ip,
  coalesce({ip_at('full_log', 2)}, agent_ip) as destination_ip,
  nullif(try_cast(dstport as int), 0) as port,
  {user('full_log')} as "user",
  event_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(millisecond(ts) % 1000 as varchar), 3, '0')
    || '+0000' as "timestamp",
  coalesce(nullif(full_log, ''), 'Rule ' || rule_id) as raw_log,
  level, rule_id, 'normalized' as status, dstport from alerts)"""

DEFAULTED = f"""{NORMALIZED},
defaulted as (select alert_id, ts,
  coalesce(nullif(source_ip, ''), '0.0.0.0') as source_ip,
  coalesce(nullif(destination_ip, ''), '0.0.0.0') as destination_ip,
  coalesce(try_cast(coalesce(nullif(dstport, ''), '5000') as int), 0) as port,
  "user", event_type, "timestamp", raw_log, coalesce(level, 0) as level, rule_id,
  'pending' as status from normalized)"""


def number(ip: str) -> str:
    terms = [
        f"try_cast(split_part({ip}, '.', {i}) as bigint) * {1 << (8 * (4 - i))}" for i in range(1, 5)
    ]
    return "(" + " + ".join(terms) + ")"


def private(ip: str) -> str:
    n = number(ip)
    ranges = [
        (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183),
        (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239),
        (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959),
        (3405803776, 3405804031), (4026531840, 4294967295),
    ]
    inside = " or ".join(f"{n} between {low} and {high}" for low, high in ranges)
    return (
        f"coalesce(regexp_full_match({ip}, '{QUAD}') and ({inside})"
        f" and {n} not in (3221225481, 3221225482), false)"
    )


def internal(ip: str) -> str:
    return (
        f"coalesce(starts_with({ip}, '10.0.0.') or starts_with({ip}, '192.168.1.1'), false)"
    )


LINES = """
lines as (select case c_custkey % 7
  when 0 then concat('# customer ', cast(c_custkey as varchar)) when 1 then ''
  when 2 then concat(' 45.33.', cast(c_custkey % 200 as varchar), '.',
    cast(c_custkey % 99 as varchar), ' ')
  when 3 then concat('192.168.1.', cast(c_custkey % 120 as varchar))
  when 4 then concat('45.33.', cast(c_custkey % 250 // 64 * 64 as varchar), '.0/18')
  when 5 then concat('198.51.100.', cast(c_custkey % 250 // 16 * 16 as varchar), '/28')
  else concat('8.8.', cast(c_custkey % 50 as varchar), '.0/24') end as value from customer),
bl as (select distinct trim(value) as entry from lines
  where value <> '' and not starts_with(value, '#'))"""


def scored(flag: str = "source_ip in (select entry from bl)") -> str:
    return f"""{DEFAULTED},{LINES},
featured as (select *, {flag} as listed,
  cast({flag} as int) * 10 + cast(not {private('source_ip')} as int) * 3 as source_ip_security,
  cast({private('destination_ip')} as int) * 3 + cast({internal('destination_ip')} as int) * 5
    as destination_ip_security,
  cast(coalesce(port in (22, 90, 443, 3306, 8080), false) as int) * 5 as port_security
  from defaulted),
severe as (select * exclude (status), cast(trunc(greatest(0, least(100,
    level::double / 15::double * 60::double + source_ip_security * 2
    + destination_ip_security * 2 + port_security))) as int) as severity from featured),
scored as (select *, case when severity < 25 then 'benign' when severity < 50 then 'suspicious'
    when severity < 75 then 'malicious' else 'critical' end as label, 'scored' as status
  from severe)"""


SCORED = scored()
UNLISTED = scored("false")

EVENT_FIELDS = [
    "source_ip", "destination_ip", "port", "user", "event_type", "timestamp", "raw_log", "level",
    "rule_id", "severity", "label",
]


def enriched(base: str, tail: str = "") -> str:
    nested = ", ".join(f'"{f}" as event_{f}' for f in EVENT_FIELDS)
    return f"""with {base},
explained as (select *, event_type || ' by user ' || coalesce("user", 'None') || ' from '
    || source_ip || ' scored ' || severity || ': ' || raw_log as explanation from scored {tail})
select alert_id, "timestamp", event_type, source_ip, severity, label, explanation, {nested},
  explanation as event_explanation, 'explained' as event_status from explained"""


RAW_LOGS = r"""
rb as (select event_id, ts, event_type, 'u' || user_id as u,
  '45.33.' || (user_id % 200) || '.' || (event_id % 250) as a,
  '10.0.0.' || (event_id % 300) as b from events),
raw_logs as (select event_id as seq, case event_id % 20
  when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.5Z account=' || u || ' x'
  when 1 then strftime(ts, 'date=%Y-%m-%d  time=%H:%M:%S hi')
  when 2 then strftime(ts, '%b  %-d %H:%M:%S') || ' h door: entry for ' || u
    || ' from ' || a
  when 3 then '[' || strftime(ts, '%a %b %d %H:%M:%S') || ' 1996] [client ' || a || '] user ' || u
    || ': x'
  when 4 then '[Thu Feb 29 ' || strftime(ts, '%H:%M:%S') || ' 1996] x'
  when 5 then '[' || lower(strftime(ts, '%a %b %d %H:%M:%S')) || ' 1996] x'
  when 6 then 'Feb 29 ' || strftime(ts, '%H:%M:%S') || ' x'
  when 7 then '[Time ' || strftime(ts, '%Y.%m.%d %H:%M:%S') || ' +02] x'
  when 8 then strftime(ts, '%H:%M:%S') || ' x ' || a || ' ' || b
  when 9 then 'NOTE ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' (' || u || '@h1)'
  when 10 then 'At ' || strftime(ts, '%H:%M:%S %d/%m/%Y') || ' user ' || u || ' "quoted, text"'
  when 11 then '[' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' ] ' || a || ' ' || b || ' 7.7.7.7'
  when 12 then 'session closed for user omar by (uid=7)'
  when 13 then '1900-' || strftime(ts, '%m-%dT%H:%M:%S') || ' x'
  when 14 then 'nothing here'
  when 15 then ''
  when 16 then null
  when 17 then '2024-13-45T25:61:61 then ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' 1.2.3.4567'
  when 18 then 'by (uid=0) grants user -' || u
  else '0000-01-01T00:00:00 x ' || strftime(ts, '%H:%M:%S') || chr(10)
    || 'session opened for user ' || u end as log,
  case when event_id % 17 = 0 then null else event_type end as category from rb)"""


def normalized_rows(source: str, keys: str, name: str = "csv_dataset", extra: str = "") -> str:
    return f"""select {keys}, {timestamp('message')} as "timestamp", category as event_type,
  {ip_at('message', 1)} as source_ip, {ip_at('message', 2)} as destination_ip,
  {user('message')} as "user", cast(0 as int) as severity, message, '{name}' as source{extra}
from (select *, coalesce(log, '') as message from {source})"""


def _colon_cases() -> str:
    def spelled(form: str) -> str:
        text = form.replace("{0}", "' || (event_id % 10) || '")
        return "'" + text.replace("{1}", "' || lower(to_hex(event_id % 65000 + 256)) || '") + "'"

    return " ".join(f"when {i} then {spelled(form)}" for i, form in enumerate(COLON_FORMS))


# Which colon forms are special-use, from the address registries.
PRIVATE_COLON_FORMS = (0, 1, 2, 4, 5, 6, 8, 11, 12, 13, 16)

SPREAD = """
sb as (select event_id, event_id % 256 as lo, event_id * 31 % 256 as mid, event_id * 131 % 256 as hi
  from events),
spread as (select event_id, case event_id % 16
  when 0 then hi || '.' || mid || '.' || lo || '.' || mid
  when 1 then '172.' || mid || '.0.' || lo
  when 2 then '192.0.0.' || (event_id // 16 % 20)
  when 3 then '198.' || mid || '.100.' || lo
  when 4 then '100.' || mid || '.' || lo || '.1'
  when 5 then '192.' || hi || '.2.' || lo
  when 6 then '10.0.0.' || (event_id % 400)
  when 7 then '0' || lo || '.2.3.4'
  when 8 then (event_id % 400) || '.1.1.1'
  when 9 then '203.0.' || mid || '.' || lo
  when 10 then '169.' || hi || '.' || lo || '.9'
  when 11 then '192.168.1.' || lo
  when 12 then ' 10.0.0.' || lo
  when 13 then null
  when 14 then '198.51.' || mid || '.' || lo
  else hi || '.168.' || mid || '.' || lo end as ip from sb)"""

IN_RANGE = f"""exists (select 1 from bl where entry = source_ip or (contains(entry, '/')
  and regexp_full_match(source_ip, '{QUAD}')
  and {number('source_ip')} >> (32 - split_part(entry, '/', 2)::int)
    = {number("split_part(entry, '/', 1)")} >> (32 - split_part(entry, '/', 2)::int)))"""

BUFFER = f"""{NORMALIZED},
last as (select *, strftime(ts, '%Y%m%d%H')::bigint as batch_id from alerts
  order by batch_id desc, ts, alert_id limit 500)"""

DASHBOARD = f"""{SCORED},
dash as (select 'EVT-' || alert_id as id, "timestamp", event_type, source_ip, "user",
  case when severity >= 80 then 'critical' when severity >= 60 then 'high'
    when severity >= 40 then 'medium' else 'low' end as severity,
  severity as score,
  case alert_id % 3 when 0 then 'open' when 1 then 'review' else 'closed' end as status, ts
  from scored)"""

KPIS = """count(*) as total, count_if(severity = 'critical') as critical,
  count_if(severity = 'high') as high, count_if(severity = 'medium') as medium,
  count_if(severity = 'low') as low"""

NORMALIZED_COLUMNS = (
    'source_ip, destination_ip, port, "user", event_type, "timestamp", raw_log, level, rule_id, '
    "status"
)


def _draw(start: int, digits: int, low: int, high: int) -> str:
    return (
        f"cast(('0x' || substr(digest, {start}, {digits}))::bigint % {high - low + 1} + {low}"
        " as int)"
    )


def _drawn_ip(start: int) -> str:
    bounds = [(1, 254), (0, 254), (0, 254), (1, 254)]
    return " || '.' || ".join(_draw(start + 4 * i, 4, *b) for i, b in enumerate(bounds))


SYNTHETIC = f"""with d as (select event_id as id, sha256('42:' || event_id) as digest from events),
r as (select id, {_drawn_ip(1)} as source_ip, {_drawn_ip(17)} as destination_ip,
  {_draw(33, 8, 1, 65535)} as port, {_draw(41, 4, 0, 15)} as level,
  ('0x' || substr(digest, 45, 8))::bigint::double / 4294967296::double * 10::double - 5::double
    as noise from d)
select id, source_ip, destination_ip, port, level, cast(trunc(greatest(0, least(100,
  level::double / 15::double * 60::double + cast(not {private('source_ip')} as int) * 3 * 2
  + (cast({private('destination_ip')} as int) * 3 + cast({internal('destination_ip')} as int) * 5)
    * 2 + cast(port in (22, 90, 443, 3306, 8080) as int) * 5 + noise))) as int) as severity,
  'pending' as status from r"""

MODEL_ROWS = f"""synthetic as ({SYNTHETIC}),
  model_rows as (select ('0x' || substr(sha256('split:42:' || id), 1, 8))::bigint % 1000 < 200
      as held_out, level, cast(not {private('source_ip')} as int) * 3 as source_ip_security,
    cast({private('destination_ip')} as int) * 3 + cast({internal('destination_ip')} as int) * 5
      as destination_ip_security,
    cast(port in (22, 90, 443, 3306, 8080) as int) * 5 as port_security, severity from synthetic)"""
PROMPT = """'You assist a security analyst. Explain this alert in a few sentences.' || chr(10)
  || 'Event type: ' || coalesce(event_type, 'None') || chr(10)
  || 'Message: ' || coalesce(raw_log, 'None') || chr(10)
  || 'User: ' || coalesce("user", 'None') || chr(10)
  || 'Source IP: ' || coalesce(source_ip, 'None') || chr(10)
  || 'Severity: ' || coalesce(severity::varchar, 'None') || chr(10)
  || 'Say what happened and what to check next.'"""

REPLAYED = "replace(coalesce(log, ''), '\"', '\\\"')"
REPLAY_COLUMNS = f"""seq, category, {REPLAYED} as value,
  substr(coalesce(log, ''), 1, 80) as shown, substr(coalesce(log, ''), 1, 100) as dry_run"""


def _cell(column: str, width: int) -> str:
    text = f"coalesce({column}::varchar, 'None')"
    return f"rpad({text}, greatest({width}, length({text}))::int, ' ')"


def _report() -> str:
    columns = [("level", 8), ("source_ip", 18), ("destination_ip", 18), ("port", 8),
               ("severity", 8), ("label", 12), ("status", 0)]
    cells = " || ' ' || ".join(_cell(c, w) for c, w in columns)
    return f"with {SCORED} select alert_id, '  ' || {cells} as line from scored"


SQL: dict[str, str] = {
    "normalize_siem_alerts": f"with {NORMALIZED} select alert_id, {NORMALIZED_COLUMNS} from normalized",
    "normalize_csv_rows": f"with {RAW_LOGS} " + normalized_rows(
        "raw_logs", "seq", extra=", log as kept_log, category as kept_category"),
    "normalize_csv_fields": """select event_id as seq,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as "timestamp",
  case when event_id % 3 = 0 then '45.33.1.' || (event_id % 250) else '10.0.0.' || user_id end
    as source_ip,
  case when event_id % 5 <> 0 then '10.0.1.' || user_id when event_id % 2 <> 0 then '8.8.8.8' end
    as destination_ip,
  event_type, 'u' || user_id as "user", cast(0 as int) as severity, props as message,
  'csv_dataset' as source,
  case when event_id % 5 <> 0 then '10.0.1.' || user_id end as kept_dst_ip,
  cast(9 as int) as kept_columns from events""",
    "normalize_conversations": normalized_rows(
        "(select conv_id, turn, text as log, role as category from conversations)",
        "conv_id, turn", "conversations"),
    "parse_timestamps": f"with {RAW_LOGS} select seq, {timestamp('log')} as \"timestamp\" from raw_logs",
    "parse_users": f"with {RAW_LOGS} select seq, {user('log')} as \"user\" from raw_logs",
    "extract_ips_documents": f"""select doc_id, {ip_at('text', 1)} as source_ip,
  {ip_at('text', 2)} as destination_ip from documents""",
    "extract_ips_pages": f"""select page_id, {ip_at('html', 1)} as source_ip,
  {ip_at('html', 2)} as destination_ip from pages""",
    "extract_users_documents": f"""select doc_id, {user('text')} as "user",
  {timestamp('text')} as "timestamp" from documents""",
    "event_json": f"""with {NORMALIZED} select alert_id, source_ip, "user", port::varchar as port,
  status from normalized""",
    "ip_classes": f"""with {DEFAULTED} select alert_id, source_ip, destination_ip,
  {private('source_ip')} as source_private, {private('destination_ip')} as destination_private,
  {internal('destination_ip')} as destination_internal from defaulted""",
    "ip_classes_wide": f"""with {SPREAD} select event_id, ip, {private('ip')} as private,
  {internal('ip')} as internal from spread""",
    "ip_classes_v6": f"""select event_id, case event_id % {len(COLON_FORMS)} {_colon_cases()} end as ip,
  event_id % {len(COLON_FORMS)} in {PRIVATE_COLON_FORMS} as private from events""",
    "adapter_defaults": f"with {DEFAULTED} select alert_id, {NORMALIZED_COLUMNS} from defaulted",
    "features": f"""with {SCORED} select alert_id, listed, level, source_ip_security,
  destination_ip_security, port_security from scored""",
    "rule_severity": f"with {SCORED} select alert_id, severity, label, status from scored",
    "label_counts": f"with {SCORED} select label, count(*) as events from scored group by label",
    "blocklist_clean": f"with {LINES} select entry from bl",
    "blocklist_size": f"with {LINES} select count(*) as entries from bl",
    "blocklist_flag": f"""with {NORMALIZED},{LINES} select alert_id, source_ip,
  coalesce(source_ip in (select entry from bl), false) as listed from normalized""",
    "blocklist_semi": f"""with {NORMALIZED},{LINES} select alert_id, source_ip from normalized
  where source_ip in (select entry from bl)""",
    "blocklist_anti": f"""with {NORMALIZED},{LINES} select alert_id, source_ip from normalized
  where not coalesce(source_ip in (select entry from bl), false)""",
    "blocklist_cidr": f"""with {NORMALIZED},{LINES} select alert_id, source_ip,
  coalesce({IN_RANGE}, false) as listed from normalized""",
    "recent_alerts_topn": f"""with {ALERTS} select alert_id, ts, level, rule_id, event_type, srcip,
  dstport, agent_ip, full_log from alerts order by ts desc, alert_id desc limit 10""",
    "recent_events_buffer": f"""with {UNLISTED},
  page as (select *, strftime(ts, '%Y%m%d%H')::bigint as batch_id from scored
    order by batch_id desc, ts, alert_id limit 100)
  select alert_id, batch_id, event_type, source_ip, severity, label from page""",
    "recent_events_tail": f"""with {BUFFER}, placed as (select *, row_number() over
    (order by batch_id, ts desc, alert_id desc) as place from last)
  select alert_id, batch_id from placed where place > 120""",
    "severity_kpis": f"with {DASHBOARD} select {KPIS} from dash",
    "severity_kpis_24h": f"""with {DASHBOARD} select {KPIS} from dash
  where ts > timestamp '2024-01-19 00:00:00' and ts <= timestamp '2024-01-20 00:00:00'""",
    "display_bands": f"""with {DASHBOARD} select id, "timestamp", event_type, source_ip, "user",
  severity, score, status from dash""",
    "alert_results": enriched(SCORED),
    "alert_results_poll": enriched(UNLISTED, "order by ts desc, alert_id desc limit 10"),
    "report_preview": f"""with {UNLISTED}, top as (select * from scored
    order by ts desc, alert_id desc limit 3)
  select '  [' || lpad(severity::varchar, 3, ' ') || '] ' || event_type || ' | ' || source_ip
    || ' | ' || substr(event_type || ' by user ' || coalesce("user", 'None') || ' from '
    || source_ip || ' scored ' || severity || ': ' || raw_log, 1, 100) as line from top""",
    "score_report": _report(),
    "replay_selection": f"""with {RAW_LOGS} select {REPLAY_COLUMNS} from (select * from raw_logs
  where category = 'error' order by seq limit 100)""",
    "replay_everything": f"with {RAW_LOGS} select {REPLAY_COLUMNS} from raw_logs",
    "replay_counters": f"""with {RAW_LOGS}, seen as (select coalesce(category = 'error', false) as hit,
    coalesce(sum(cast(coalesce(category = 'error', false) as int)) over (order by seq
      rows between unbounded preceding and 1 preceding), 0) as before from raw_logs)
  select count_if(hit) as injected, count_if(not hit) as skipped from seen where before < 100""",
    "replay_sink": f"""with {RAW_LOGS}
  select unnest(string_split({REPLAYED}, chr(10))) as value from raw_logs""",
    "csv_logs_to_json": f"""with {RAW_LOGS}, filled as (select seq, coalesce(log, '') as log,
    coalesce(category, '') as category from raw_logs) """ + normalized_rows("filled", "seq"),
    "csv_fields_to_json": """select event_id as seq,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as "timestamp",
  case when event_id % 3 = 0 then '45.33.1.' || (event_id % 250) else '10.0.0.' || user_id end
    as source_ip,
  case when event_id % 5 <> 0 then '10.0.1.' || user_id when event_id % 2 <> 0 then '8.8.8.8'
    else '' end as destination_ip,
  event_type, 'u' || user_id as "user", coalesce(props, '') as message from events""",
    "json_alert_scan": f"""with {NORMALIZED} select alert_id::varchar as id, {NORMALIZED_COLUMNS}
  from normalized""",
    "envelope_scan": f"""with {NORMALIZED} select alert_id::varchar as id, source_ip,
  destination_ip, "user", event_type, level from normalized where alert_id % 10 <> 0""",
    "synthetic_events": SYNTHETIC,
    "stream_results_once": enriched(SCORED),
    "stream_repeats": f"with {UNLISTED} select alert_id, severity, label, status from scored",
    "stream_kpi_24h": f"""with {UNLISTED},
  dash as (select ts, case when severity >= 80 then 'critical' when severity >= 60 then 'high'
    when severity >= 40 then 'medium' else 'low' end as severity from scored)
  select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start,
    strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d %H:%M:%S') as "end", {KPIS}
  from dash group by date_trunc('day', ts)""",
}
SQL["explanation_prompts"] = f"with {UNLISTED} select alert_id, {PROMPT} as prompt from scored"
SQL["explained_by_callable"] = f"""with {UNLISTED} select alert_id,
  'a prompt of ' || length({PROMPT}) as explanation, 'explained' as status from scored"""
SQL["model_mae"] = f"""with {MODEL_ROWS}
  select count_if(held_out) as test_rows, true as within_bound from model_rows"""
SQL["model_cells"] = f"""with {MODEL_ROWS}
  select held_out, level, source_ip_security, destination_ip_security, port_security, severity,
    count(*) as n from model_rows group by all"""
SQL["model_scores"] = f"""with {SCORED} select alert_id, level, source_ip_security,
  destination_ip_security, port_security, true as within_bound, true as label_fits from scored"""
SQL["leafwise_mae"] = SQL["model_mae"]
SQL["leafwise_root"] = f"""with {MODEL_ROWS},
  train as (select * from model_rows where not held_out),
  whole as (select avg(severity) as mean, count(*) as n from train),
  long as (unpivot (select severity, level, source_ip_security, destination_ip_security,
    port_security from train) on level, source_ip_security, destination_ip_security, port_security
    into name feature value x),
  steps as (select feature, x, sum(severity - mean) as s, count(*) as c from long, whole
    group by feature, x),
  cuts as (select feature, (x + lead(x) over w) / 2.0 as threshold, sum(s) over w as s,
    sum(c) over w as c from steps window w as (partition by feature order by x))
  select feature, threshold, round(s * s / c + s * s / (n - c), 3) as gain, n as train_rows
  from cuts, whole where threshold is not null and c >= 20 and n - c >= 20
  order by s * s / c + s * s / (n - c) desc limit 1"""
SQL["leafwise_stream"] = f"""with {NORMALIZED} select alert_id, true as same, true as within_bound
  from normalized"""
SQL["explained_once"] = SQL["explained_by_callable"]
SQL["recent_alerts_pruned"] = SQL["recent_alerts_topn"]
SQL["logs_to_json_array"] = f"""with {RAW_LOGS}, filled as (select seq, coalesce(log, '') as log,
    category from raw_logs), found as ({normalized_rows("filled", "seq")})
  select seq, "timestamp", event_type, source_ip, "user" from found"""
SQL["score_report_table"] = f"""select alert_id, 2::int as place, line from ({_report()})
  union all select null, 0, '  level    source_ip          destination_ip     port     severity label        status'
  union all select null, 1, '  -------- ------------------ ------------------ -------- -------- ------------ ------'"""
SQL["replay_selection_cut"] = SQL["replay_selection"]
SQL["model_reuse"] = f"with {NORMALIZED} select alert_id, true as same from normalized"
SQL["blocklist_flag_shuffled"] = SQL["blocklist_flag"]
SQL["blocklist_flag_hot"] = SQL["blocklist_flag"]
SQL["blocklist_cidr_shuffled"] = SQL["blocklist_cidr"]

# Addresses as numbers, without their text: 45.33 and 16 bits, or the third group and the last.
_ADDRESSES = """addresses as (select event_id, user_id * 13 % 4096 as third,
    event_id % 65536 as last, user_id * 13 % 256 * 256 + event_id % 256 as dotted,
    case when event_id % 5 = 0 then 4 when event_id % 5 < 4 then 6 end as family from events),
  wide as (select c_custkey * 7 % 4096 as third, 6 - c_custkey % 7 as spare from customer
    where c_custkey % 11 = 0),
  narrow as (select s_suppkey * 13 % 4096 as third, s_suppkey * 37 % 65536 as last,
    15 - s_suppkey % 16 as spare from supplier),
  dotted as (select s_suppkey * 29 % 256 * 256 + s_suppkey * 5 % 256 as number,
    case when s_suppkey % 2 = 0 then 0 else 11 - s_suppkey % 12 end as spare
    from supplier where s_suppkey % 3 = 0)"""
SQL["blocklist_networks"] = f"""with {_ADDRESSES} select event_id, case event_id % 5
    when 0 then concat_ws('.', 45, 33, user_id * 13 % 256, event_id % 256)
    when 1 then printf('2001:db8:%x::%x', user_id * 13 % 4096, event_id % 65536)
    when 2 then printf('2001:0DB8:%X:0:0:0:0:%X', user_id * 13 % 4096, event_id % 65536)
    when 3 then printf('2001:db8:%x::0.0.%d.%d', user_id * 13 % 4096,
      event_id % 65536 // 256, event_id % 256)
    else case when event_id % 2 = 1 then 'host' end end as ip,
  coalesce(family = 6 and exists (select 1 from wide w
      where w.third >> w.spare = a.third >> w.spare), false)
  or coalesce(family = 6 and exists (select 1 from narrow n where n.third = a.third
      and n.last >> n.spare = a.last >> n.spare), false)
  or coalesce(family = 4 and exists (select 1 from dotted d
      where d.number >> d.spare = a.dotted >> d.spare), false) as listed
  from addresses a join events using (event_id)"""
SQL["blocklist_networks_swept"] = SQL["blocklist_networks"]
SQL["blocklist_intervals"] = f"""with {_ADDRESSES}, spans as (
    select printf('620010db8%04x%s', third >> spare << spare, repeat('0', 20)) as low,
      printf('620010db8%04x%s', (third >> spare << spare) + (1 << spare) - 1, repeat('f', 20))
      as high from wide union
    select printf('620010db8%04x%s%04x', third, repeat('0', 16), last >> spare << spare),
      printf('620010db8%04x%s%04x', third, repeat('0', 16),
        (last >> spare << spare) + (1 << spare) - 1) from narrow union
    select printf('42d21%04x', number >> spare << spare),
      printf('42d21%04x', (number >> spare << spare) + (1 << spare) - 1) from dotted),
  reached as (select *, max(high) over (order by low, high rows between unbounded preceding
    and 1 preceding) as reach from spans),
  numbered as (select *, sum(case when reach >= low then 0 else 1 end) over
    (order by low, high rows unbounded preceding) as island from reached)
  select min(low) as low, max(high) as high from numbered group by island"""
SQL["blocklist_semi_shuffled"] = SQL["blocklist_semi"]
SQL["blocklist_anti_shuffled"] = SQL["blocklist_anti"]
SQL["stream_kpi_rolling"] = f"""with {UNLISTED},
  dash as (select ts, case when severity >= 80 then 'critical' when severity >= 60 then 'high'
    when severity >= 40 then 'medium' else 'low' end as severity from scored),
  times as (select unnest({READING_TIMES!r})::timestamp as moment)
  select strftime(moment, '%Y-%m-%d %H:%M:%S') as as_of, count(ts) as total,
    count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high,
    count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low
  from times left join dash on ts <= moment and ts > moment - interval 24 hours group by moment"""
SQL["stream_buffer"] = f"""with {UNLISTED}
  select alert_id, source_ip, event_type, severity, label, status from scored
  order by alert_id % 3 desc, ts, alert_id limit 500"""
SQL["stream_metrics"] = """select 4::bigint as batches, (3 * count(*))::bigint as polled,
  (2 * count(*))::bigint as repeats, count(*)::bigint as written from events"""
SQL["stream_polled"] = f"""with {UNLISTED} select alert_id::varchar as id, severity, label, status,
  true as within_cap from scored"""
SQL["replay_paced"] = """select event_id as seq,
  (event_id // ceil((max(event_id) over () + 1) / 4)::bigint)::int as batch from events"""
