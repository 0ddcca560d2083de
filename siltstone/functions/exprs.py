"""Column helpers: names, sizes, times, ranks. All are JVM expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risks from the least to the greatest, and size units.
RISKS = ["low", "medium", "high", "critical"]
UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
#: Fixed value: what marks a file name as a copy, before its extension; \d is any Unicode digit.
COPY_MARK = r"(?: \(\d+\)|\(\d+\)| copy(?: \d+)?)"


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def sparse_flag(allocated: Column, size: Column) -> Column:
    return F.when(allocated < size, "yes").otherwise("no")


def risk_rank(risk: Column, unknown: int = 0) -> Column:
    out = F.lit(unknown)
    for rank, name in reversed(list(enumerate(RISKS))):
        out = F.when(risk == name, rank).otherwise(out)
    return out


def risk_of_rank(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in RISKS]), rank), F.lit("medium"))


def within(path: Column, parent: Column) -> Column:
    """Whether path is parent or lies beneath it, by components."""
    return (path == parent) | F.startswith(path, F.concat(F.rtrim(parent, F.lit("/")), F.lit("/")))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension_of(name: Column) -> Column:
    """As splitext: leading dots do not start an extension."""
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)


def copy_score(path: Column) -> Column:
    """1 if the name ends in a copy mark before its extension."""
    return F.when(name_of(path).rlike(rf"(?iU){COPY_MARK}\.[^.]+(?=\n?\z)"), 1).otherwise(0)


@functools.cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(lower-case characters that fold to one other, those others, (character, text) of those that fold to several), from the Unicode data of this Python."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for c in map(chr, range(0x110000)):
        low, fold = c.lower(), c.casefold()
        if low != fold and len(low) == 1:
            (one if len(fold) == 1 else several)[low] = fold
    return "".join(one), "".join(one.values()), tuple(several.items())


def folded(text: Column) -> Column:
    """Full case folding, so that texts which differ in case alone are equal: lower case, and the characters whose folding is another."""
    singles, targets, several = _folds()
    low = F.translate(F.lower(text), singles, targets)
    spelled = low
    for c, fold in several:
        spelled = F.replace(spelled, F.lit(c), F.lit(fold))
    return F.when(low.rlike("[" + "".join(c for c, _ in several) + "]"), spelled).otherwise(low)


def plain_name(path: Column) -> Column:
    """The case-folded name without a copy mark."""
    name = name_of(path)
    extension = extension_of(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    return folded(F.concat(F.regexp_replace(stem, rf"(?iU){COPY_MARK}(?=\n?\z)", ""), extension))


def glob_pattern(glob: str) -> str:
    """A regular expression for a right-anchored path glob: * and ? stay within a component, ** acts as *."""
    absolute = glob.startswith("/")
    parts = [p for p in glob.split("/") if p]
    out = []
    for part in parts:
        text, i = "", 0
        while i < len(part):
            c = part[i]
            close = part.find("]", i + 2) if c == "[" else -1
            if c == "*":
                text += "[^/]*"
            elif c == "?":
                text += "[^/]"
            elif close > 0:
                body = part[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                text += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = close
            else:
                text += "\\Q" + c + "\\E"
            i += 1
        out.append(text.replace("[^/]*[^/]*", "[^/]*"))
    return ("(?s)^/" if absolute else "(?s)(?:^|/)") + "/".join(out) + r"\z"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def human_bytes(size: Column) -> Column:
    unit = F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10), F.lit(len(UNITS) - 1)).cast("int")
    value = size.cast("double") / F.pow(F.lit(1024.0), unit.cast("double"))
    return F.format_string("%.2f %s", F.bround(value, 2), F.get(F.array(*[F.lit(u) for u in UNITS]), unit))


def iso_time(ns: Column) -> Column:
    """Nanoseconds since the epoch as ISO text in UTC: whole microseconds, left out if zero; null gives ''. Needs a UTC session."""
    seconds = (ns.cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("double")
    whole = F.when(seconds >= 0, F.floor(seconds)).otherwise(F.ceil(seconds))
    micros = whole * 1_000_000 + F.rint((seconds - whole) * 1e6).cast("bigint")
    stamp = F.timestamp_micros(micros)
    fraction = F.pmod(micros, F.lit(1_000_000))
    text = F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != 0, F.format_string(".%06d", fraction)).otherwise(""), F.lit("+00:00"))
    return F.coalesce(text, F.lit(""))


def display(text: Column) -> Column:
    """Control characters escaped as they are shown: \\n, \\r, \\t, others as \\xNN."""
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    for code in [*range(9), 11, 12, *range(14, 32), 127]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return text
