"""Text and colour functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def is_external(target: Column) -> Column:
    """Does a link have a scheme or start with two slashes?"""
    return target.rlike(r"^(//|[A-Za-z][A-Za-z0-9+.-]*:)")


def slug(heading: Column) -> Column:
    """Anchor of a heading: links become their text, letters lower, only word characters, '-' and '_' stay."""
    plain = F.regexp_replace(heading, r"\[([^\]]*)\]\([^)]*\)", "$1")
    kept = F.regexp_replace(F.lower(F.trim(plain)), r"[^\p{L}\p{N} _-]", "")
    return F.replace(kept, F.lit(" "), F.lit("-"))


def resolve_path(path: Column, folder: Column) -> Column:
    """Normalise ``path`` against ``folder``; null if it leaves the root, '/x' starts at the root."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    step = lambda acc, part: (
        F.when(acc.isNull(), acc)
        .when(part.isin("", "."), acc)
        .when(part == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.array_append(acc, part))
    )
    start = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(whole, "/"), start, step), "/")


def fingerprint_text(message: Column) -> Column:
    """A message with white space collapsed and digit runs replaced, so that counts do not change its identity."""
    return F.regexp_replace(collapse_space(message), "[0-9]+", "#")


def quantity(text: Column) -> Column:
    """'12 KiB' as struct(number, unit); null where it is none."""
    n = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%]*)\s*$", 1)
    return F.when(n != "", F.struct(n.cast("double").alias("number"), F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%]*)\s*$", 2).alias("unit")))


def age(seconds: Column) -> Column:
    """A whole number of the largest unit: days, hours or minutes."""
    return F.when(seconds >= 86400, F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d"))).when(seconds >= 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of a colour with channels 0 to 1."""
    channel = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def glob_pattern(glob: str) -> str:
    """A path pattern as an anchored regular expression, compiled once on the driver.

    ``**`` crosses folders (``**/`` also stands for no folder), ``*`` and ``?`` stay in one,
    ``[...]`` is a class (``!`` negates), ``{a,b}`` are alternatives, which nest.
    """
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append("[" + ("^/" + inner[1:] if inner[:1] == "!" else inner) + "]")
            i = end + 1
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.sub(r"([^\w/-])", r"\\\1", c))
        i += 1
    if depth:
        raise ValueError(f"{glob!r}: a brace is not closed")
    return "^" + "".join(out) + r"\z"


def css_length(text: Column, root: float = 16.0) -> Column:
    """struct(kind, px): px as given, rem times ``root``, zero; percentages, auto, calc and others have no px."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(px|rem|%)?\z", 1)
    unit = F.regexp_extract(t, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(px|rem|%)?\z", 2)
    n = F.when(number != "", number.cast("double"))
    kind = F.when((n == 0) & (unit == ""), "zero").when(n.isNotNull() & (unit == "px"), "px").when(n.isNotNull() & (unit == "rem"), "rem").when(n.isNotNull() & (unit == "%"), "percent").when(t == "auto", "auto").when(t.startswith("calc("), "calc").when(t.isNotNull(), "other")
    px = F.when(kind == "zero", F.lit(0.0)).when(kind == "px", n).when(kind == "rem", n * root)
    return F.struct(kind.alias("kind"), px.alias("px"))


def version_key(version: Column) -> Column:
    """All numeric components without the zeros at the end: keys compare as versions do."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit("([0-9]+)"), 1), lambda x: x.cast("long"))
    used = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(F.lit(0))))
    return F.slice(numbers, F.lit(1), F.coalesce(used, F.lit(0)))


#: How deep braces of a pattern that is data may nest.
BRACES = 6


def glob_pattern_column(glob: Column) -> Column:
    """:func:`glob_pattern` for patterns that are data: ``**``, ``*``, ``?``, classes and alternatives, which nest.

    A comma outside of braces is a comma; a brace that is not closed, or nests deeper than ``BRACES``, is itself.
    Tables of patterns are joined by :mod:`trivium.operators.globs` instead.
    """
    p = F.regexp_replace(glob, r"([.+^$()|\\])", r"\\$1")
    # The innermost braces first: their commas separate, then they are groups themselves.
    for _ in range(BRACES):
        p = F.regexp_replace(p, r",(?=[^{}]*\})(?<=\{[^{}]{0,4096})", "\x07")
        p = F.regexp_replace(p, r"\{([^{}]*)\}", "\x05$1\x06")
    p = F.regexp_replace(p, r"([{}])", r"\\$1")
    for mark, what in (("\x01", "**/"), ("\x02", "**"), ("\x03", "*"), ("\x04", "?")):
        p = F.replace(p, F.lit(what), F.lit(mark))
    for mark, regex in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", "[^/]"), ("\x05", "(?:"), ("\x06", ")"), ("\x07", "|"), ("[!", "[^/")):
        p = F.replace(p, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), p, F.lit(r"\z"))


def fingerprint(rule: Column, anchor: Column, message: Column) -> Column:
    """Identity of a finding: a digest of its rule, its anchor and its message without numbers, each with its length before it."""
    part = lambda c: F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(part(rule), part(anchor), part(fingerprint_text(message))).cast("binary"), 256)


def called_names(body: Column) -> Column:
    """Distinct identifiers that stand before '(' and are not declared there."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?<![\w!])(?<!\bfn\s)(?<!\bdef\s)([A-Za-z_]\w*)\s*\("), 1))


def is_ulid(text: Column) -> Column:
    """26 digits of base 32, the first at most 7."""
    return text.rlike(r"^[0-7][0-9A-HJKMNP-TV-Z]{25}\z")


def redact_homes(text: Column) -> Column:
    """Names of home folders replaced."""
    return F.regexp_replace(text, r"(/home/|/Users/|[A-Za-z]:\\Users\\)[^/\\\s]+", "$1<user>")


# Words that add nothing to the name of a rule.
FILLER = (
    "does", "do", "not", "no", "apply", "applies", "to", "this", "here", "is", "ok", "okay",
    "fine", "the", "a", "rule", "ignore", "ignored", "skip", "skipped", "disabled",
)


#: Phrases that no reason may hold, in the order in which they are looked for.
BANNED = ("temporary", "temporarily", "for now", "fix later", "wip", "todo", "tbd", "n a")


def reason_fault(reason: Column, least: int = 15, banned: tuple[str, ...] = BANNED) -> Column:
    """Why a reason is refused, null if it is not: too short, a banned phrase, only a rule's name, a repeated word."""
    trimmed = F.trim(reason)
    words = F.filter(F.split(F.lower(trimmed), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrase = F.coalesce(*(F.when(line.contains(f" {' '.join(p.lower().split())} "), F.lit(p)) for p in banned)) if banned else F.lit(None)
    is_rule = lambda w: w.rlike(r"^[a-z]{2,6}[0-9]{3}\z")
    bare = F.exists(words, is_rule) & F.forall(words, lambda w: is_rule(w) | w.isin(*FILLER))
    twice = F.exists(F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: a == b), lambda x: x)
    return F.when(F.length(trimmed) < least, "short").when(phrase.isNotNull(), "banned").when(bare, "restates").when(twice, "repeats")


def hex_colour(text: Column) -> Column:
    """#rgb, #rgba, #rrggbb or #rrggbbaa as struct(r, g, b, a) of 0 to 1; null if it is none."""
    digits = F.regexp_extract(F.lower(F.trim(text)), r"^#([0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{3,4})\z", 1)
    full = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    channel = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255.0
    return F.when(digits != "", F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"), F.when(F.length(full) == 8, channel(7)).otherwise(F.lit(1.0)).alias("a")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels 0 to 1, bytes rounded half to even."""
    byte = lambda c: F.lpad(F.lower(F.hex(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255.0).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def redmean(a: Column, b: Column) -> Column:
    """Distance of two colour structs, weighted by their mean red."""
    mean = (a["r"] + b["r"]) * 255.0 / 2.0
    d = {c: (a[c] - b[c]) * 255.0 for c in "rgb"}
    return F.sqrt((2.0 + mean / 256.0) * d["r"] * d["r"] + 4.0 * d["g"] * d["g"] + (2.0 + (255.0 - mean) / 256.0) * d["b"] * d["b"])


def identifier(name: Column) -> Column:
    """A name with runs of other characters than letters, digits and '_' as single '-'; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]+", "-"), r"^-+|-+$", "")


def hsl_colour(text: Column) -> Column:
    """hsl(h, s%, l%) as struct(r, g, b, a) of 0 to 1; null if it is none."""
    form = r"^hsl\(\s*([0-9.]+)(?:deg)?\s*,\s*([0-9.]+)%\s*,\s*([0-9.]+)%\s*\)\z"
    t = F.lower(F.trim(text))
    part = lambda i: F.try_to_number(F.regexp_extract(t, form, i), F.lit("999999.999999")).cast("double")
    h, s, l = part(1) % 360.0 / 30.0, F.least(part(2), F.lit(100.0)) / 100.0, F.least(part(3), F.lit(100.0)) / 100.0
    a = s * F.least(l, 1.0 - l)

    def channel(n: int) -> Column:
        k = (h + float(n)) % 12.0
        return l - a * F.greatest(F.lit(-1.0), F.least(k - 3.0, 9.0 - k, F.lit(1.0)))

    return F.when(t.rlike(form), F.struct(channel(0).alias("r"), channel(8).alias("g"), channel(4).alias("b"), F.lit(1.0).alias("a")))


def rgb_colour(text: Column) -> Column:
    """rgb(r, g, b) with numbers up to 255 as struct(r, g, b, a) of 0 to 1; null if it is none."""
    form = r"^rgba?\(\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*\)\z"
    t = F.lower(F.trim(text))
    part = lambda i: F.least(F.regexp_extract(t, form, i).try_cast("double"), F.lit(255.0)) / 255.0
    return F.when(t.rlike(form), F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b"), F.lit(1.0).alias("a")))


def bare_markers(line: Column, markers: tuple[str, ...] = ("TODO", "FIXME", "HACK", "XXX")) -> Column:
    """Work markers of a line that name no owner in brackets right after them, in their order."""
    return F.regexp_extract_all(line, F.lit(rf"(?<![A-Za-z0-9_])({'|'.join(markers)})(?![A-Za-z0-9_])(?!\([^)]+\))"), 1)


def line_at(text: Column, offset: Column) -> Column:
    """struct(line, col, col16) from 0 of a byte offset: line, bytes and UTF-16 units before it in its line; null beyond the text."""
    raw = F.encode(text, "UTF-8")
    before = F.decode(F.substring(raw, F.lit(1), offset.cast("int")), "UTF-8")
    last = F.substring_index(before, "\n", -1)
    wide = F.length(F.regexp_replace(last, r"[\x{10000}-\x{10FFFF}]", "ab"))
    inside = (offset >= 0) & (offset <= F.octet_length(text))
    return F.when(inside, F.struct((F.size(F.split(before, "\n", -1)) - 1).alias("line"), F.octet_length(last).alias("col"), wide.alias("col16")))


def instant(seconds: Column) -> Column:
    """The moment so many seconds after 1970 began."""
    return F.timestamp_seconds(seconds)


def plus_seconds(at: Column, seconds: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * 1_000_000)


def day_of(at: Column) -> Column:
    """The day of a moment, in UTC whatever the session's zone; null before year 1 and after 9999."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))
    return F.when(F.year(day).between(1, 9999), day)


def plus_days(day: Column, days: Column | int) -> Column:
    """A day moved; null where it leaves the years 1 to 9999."""
    moved = F.date_add(day, (F.lit(days) if isinstance(days, int) else days).cast("int"))
    return F.when(F.year(moved).between(1, 9999), moved)


def private_terms(text: Column, terms: tuple[str, ...], instead: str = "[private]") -> Column:
    """A text without the private terms, which are whole words in any case; the longest of several counts."""
    if not terms:
        return text
    listed = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iu)(?<![\w])(?:{listed})(?![\w])", instead.replace("\\", r"\\").replace("$", r"\$"))


def valid_glob(glob: Column) -> Column:
    """Can a pattern be read: it is not empty, braces and brackets are closed, and no name is ``..``?"""
    bare = F.regexp_replace(glob, r"\[[!^]?\]?[^\]]*\]", "x")
    for _ in range(BRACES):
        bare = F.regexp_replace(bare, r"\{[^{}]*\}", "x")
    return (glob != "") & ~bare.rlike(r"[\[{}]") & ~glob.rlike(r"(?:^|/)\.\.(?:/|\z)")


def range_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Does the half-open range a hold b?"""
    return (a_start <= b_start) & (b_end <= a_end)


def range_cover(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The least range that holds both."""
    return F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end"))


def range_meet(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """What two half-open ranges share, which may be empty; null if they are apart."""
    lo, hi = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(lo <= hi, F.struct(lo.alias("start"), hi.alias("end")))


def class_candidates(attribute: Column) -> Column:
    """The classes of a list, each as struct(variants, name, important): ``sm:hover:!p-2`` has the variants sm and hover.

    A colon within brackets separates nothing.
    """
    words = F.filter(F.split(F.trim(attribute), r"\s+"), lambda w: w != "")
    colon = r":(?![^\[]*\])"
    parts = lambda w: F.split(w, colon)
    plain = lambda w: F.element_at(parts(w), -1)
    return F.transform(words, lambda w: F.struct(F.slice(parts(w), F.lit(1), F.size(parts(w)) - 1).alias("variants"), F.regexp_replace(plain(w), r"^!|!$", "").alias("name"), plain(w).rlike(r"^!|!$").alias("important")))


def step_name(step: Column) -> Column:
    """A step of a scale as text: no zeros at the end, no point without digits after it."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", step.cast("double")), "0+$", ""), r"\.$", "")


def language(path: Column, known: dict[str, str]) -> Column:
    """The language of a path by the ending of its last segment, null if none is known."""
    name = F.lower(F.substring_index(path, "/", -1))
    ending = F.when(name.contains("."), F.substring_index(name, ".", -1))
    return F.coalesce(*(F.when(ending == e, l) for e, l in known.items()), F.lit(None).cast("string"))


def role(path: Column, ledger: str = "tickets") -> Column:
    """``ledger`` for paths below a folder of that name (a whole component), else ``source``."""
    return F.when(F.array_contains(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), ledger), "ledger").otherwise("source")


def stored_text(text: Column) -> Column:
    """A text as a repository stores it: lines end in a line feed alone."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))
