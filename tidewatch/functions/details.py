"""Key-value pairs inside detail fields, and the scalar functions over their text."""

from __future__ import annotations

import base64
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.logs import SEPARATOR

# Keys of indicators by category, for Details (with ExtraFieldInfo) and for AllFieldInfo.
IOC_KEYS = {
    "process": ["Proc", "Image", "ParentImage"],
    "cmdline": ["Cmdline"],
    "filepath": ["Path", "TgtFile"],
    "ip": ["SrcIP", "DstIP", "SrcAddr", "DstAddr", "IpAddress", "DestAddress", "SourceAddress"],
    "user": ["User", "TgtUser", "SrcUser"],
    "hash": ["Hash", "Hashes"],
    "service": ["Svc"],
}
ALL_FIELD_IOC_KEYS = {
    "process": ["Image", "ParentImage", "ImageLoaded", "NewProcessName", "ParentProcessName", "ProcessName"],
    "cmdline": ["CommandLine", "ParentCommandLine"],
    "filepath": ["TargetFilename", "RelativeTargetName", "ObjectName", "Path"],
    "ip": ["SourceIp", "DestinationIp", "IpAddress"],
    "user": ["User", "ParentUser", "SubjectUserName", "TargetUserName", "TargetOutboundUserName"],
    "hash": ["Hashes", "Hash"],
    "service": ["ServiceName", "ServiceFileName", "ImagePath"],
}
# Tactic codes and phases.
TACTICS = {
    "Recon": "Reconnaissance", "ResDev": "Resource Development", "InitAccess": "Initial Access", "Exec": "Execution", "Persis": "Persistence",
    "PrivEsc": "Privilege Escalation", "Evas": "Defense Evasion", "CredAccess": "Credential Access", "Disc": "Discovery", "LatMov": "Lateral Movement",
    "Collect": "Collection", "C2": "Command and Control", "Exfil": "Exfiltration", "Impact": "Impact",
}
# Levels by priority.
LEVELS = ["info", "low", "med", "high", "crit"]


def pairs(c: Column) -> Column:
    return F.split(c, SEPARATOR)


def pair_key(pair: Column) -> Column:
    """The text before the first ': ', trimmed; null without ': '."""
    return F.when(F.instr(pair, ": ") > 0, F.trim(F.substring_index(pair, ": ", 1)))


def pair_value(pair: Column) -> Column:
    """What follows the first ': ', trimmed; null without ': '."""
    at = F.instr(pair, ": ")
    return F.when(at > 0, F.trim(F.substring(pair, at + 2, F.length(pair))))


def ioc_value(pair: Column) -> Column:
    """The value from the trimmed key's length plus 3 on: blanks at a key's end are not counted."""
    return F.trim(F.substring(pair, F.length(pair_key(pair)) + 3, F.length(pair)))


def detail_map(c: Column) -> Column:
    """All pairs as a map; of repeated keys the last one counts."""
    kept = F.filter(pairs(c), lambda p: F.instr(p, ": ") > 0)
    keys = F.transform(kept, pair_key)
    entries = F.transform(kept, lambda p, i: F.struct(pair_key(p).alias("k"), pair_value(p).alias("v"), i.alias("i")))
    # Only rows in which a key comes twice look for its last place.
    last = F.filter(entries, lambda s: ~F.array_contains(F.slice(keys, s["i"] + 2, F.size(keys) + 1), s["k"]))
    kept_entries = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last)
    return F.map_from_entries(F.transform(kept_entries, lambda s: F.struct(s["k"], s["v"])))


def ordered_set(c: Column) -> Column:
    """Distinct values in order, joined by ', '; null where there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit(""))


def level_rank(c: Column) -> Column:
    """0 for info up to 4 for crit; -1 for anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), c), F.lit(0)), F.lit(0)) - 1


def phase(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TACTICS.items() for x in kv]), code), code)


def shortened(c: Column, size: int = 80) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


# Control and direction characters that are shown escaped.
UNSAFE = [*range(0, 9), 11, 12, *range(14, 32), 127, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]


def escaped(c: Column) -> Column:
    """Control and direction characters written out as \\xNN or \\uNNNN."""
    def one(x: Column, n: int) -> Column:
        return F.replace(x, F.lit(chr(n)), F.lit(f"\\x{n:02x}" if n < 256 else f"\\u{n:04x}"))

    return F.when(c.rlike("[" + "".join(f"\\x{{{n:x}}}" for n in UNSAFE) + "]"), reduce(one, UNSAFE, c)).otherwise(c)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_external(c: Column) -> Column:
    """An IPv4 address or a dotted name as a whole."""
    return c.rlike(r"^((\d{1,3}\.){3}\d{1,3}|([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})$")


#: Spellings of the switch for an encoded command: every beginning of it that is told apart, and its short form.
SWITCHES = ["encodedcommand"[:n] for n in range(14, 0, -1)] + ["ec"]
_SWITCH = r"(?i)(?<![-–—―/])(?:/|-{1,2}|–{1,2}|—{1,2}|―{1,2})(?:" + "|".join(SWITCHES) + r")\s+([A-Za-z0-9+/=]{4,})"


def encoded_commands(c: Column) -> Column:
    """The Base64 operands of encoded-command switches."""
    return F.regexp_extract_all(c, F.lit(_SWITCH), F.lit(1))


def has_encoded_command(c: Column) -> Column:
    return c.rlike(_SWITCH)


@F.pandas_udf(StringType())
def _decoded(operands: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return x if x is None else base64.b64decode(x).decode("utf-16-le", errors="replace")
        except ValueError:
            return "(decode error)"

    return operands.map(one)


def decoded(c: Column) -> Column:
    """Base64 of UTF-16LE as text, with replacement characters; '(decode error)' where it is no Base64; null for null."""
    return _decoded(c)
