"""Secret scanner: fixed patterns, then sliding-window entropy over candidate strings.

The patterns find ``assign``, ``access`` and ``hex`` spans. The entropy method
looks at every other run of ``candidate`` characters of at least ``window``: its
character class (hex, alphanumeric, base64) sets a threshold, and the Shannon
entropy of each window of it is kept up to date by the counts of the character
that leaves and the one that comes in (the sum of c log c changes by these two
only). A run whose best window reaches its class's threshold is an ``entropy``
span, unless the allow list knows it, it has no digit and letter, or a pattern's
span overlaps it. All columns are built-in expressions over whole texts; spans
are in code points, end exclusive.

Defined cases: null and empty texts have no spans; overlapping spans of different
kinds all stay, in order of start, then kind; repeated rows are scanned each;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns; a match of ``assign`` counts if its value has 8 characters or more.
ASSIGN_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN = ASSIGN_KEY + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS = 8

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: (class, whole-string pattern, bits a character), first that fits.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^.*$", 3.8))
#: Known harmless shapes: UUIDs, placeholders, dates in paths.
ALLOW = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
         r"(^|/)(19|20)[0-9]{2}[-/][01][0-9][-/][0-3][0-9](/|$)")

_SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _spans(text: Column, pattern: str, rank: int, group: int = 2, when: Column | None = None) -> Column:
    """Spans of the leftmost matches: the texts between matches and the matches, added up. The
    end of the text counts as a last, empty match, else the search for another match would
    start anew at every place of the rest."""
    whole = f"(?s)(.*?)({pattern}|\\z)"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gap"),
                         F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("match"),
                         F.regexp_extract_all(text, F.lit(whole), F.lit(group)).alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), part["value"].alias("value"))
        spans = F.when(end > start, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    found = F.aggregate(parts, zero, step, lambda state: state["spans"])
    present = F.rlike(text, F.lit(pattern)) if when is None else when
    return F.when(present, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _times(chars: Column, c: Column) -> Column:
    return F.size(F.filter(chars, lambda x: x == c))


def best_window_entropy(value: Column, window: int) -> Column:
    """Largest entropy in bits a character over the windows of ``value`` (at least ``window`` long)."""
    chars = F.split(value, "")
    first = F.slice(chars, 1, window)
    start = F.aggregate(F.array_distinct(first), F.lit(0.0), lambda s, c: s + _c_log_c(_times(first, c)))
    moves = F.when(F.size(chars) > window, F.sequence(F.lit(window), F.size(chars) - 1)).otherwise(
        F.array().cast("array<int>"))

    def step(state: Column, i: Column) -> Column:
        held = F.slice(chars, i - window + 1, F.lit(window))
        gone, new = F.get(chars, i - window), F.get(chars, i)
        c_gone = _times(held, gone)
        c_new = _times(held, new) - F.when(gone == new, 1).otherwise(0)
        s = (state["s"] - _c_log_c(c_gone) + _c_log_c(c_gone - 1) - _c_log_c(c_new) + _c_log_c(c_new + 1))
        return F.struct(s.alias("s"), F.least(state["least"], s).alias("least"))

    least = F.aggregate(moves, F.struct(start.alias("s"), start.alias("least")), step, lambda state: state["least"])
    return F.log2(F.lit(float(window))) - least / window


def is_secret(value: Column, window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> Column:
    threshold = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        threshold = F.when(F.rlike(value, F.lit(pattern)), F.lit(bits)).otherwise(threshold)
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    for pattern in allow:
        mixed = mixed & ~F.rlike(value, F.lit(pattern))
    return F.when(mixed, best_window_entropy(value, window) >= threshold).otherwise(F.lit(False))


def rendered(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (start, rank of the kind, end, value)
    in order. Each step is a column of its own, so that no expression is worked out twice."""
    text = F.col(text_col)
    assign = F.filter(_spans(text, ASSIGN, 0, 3, F.rlike(text, F.lit(ASSIGN_KEY))),
                      lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    out = docs.withColumn("base_spans", F.when(text.isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(
        F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))))
    out = out.withColumn("all_spans", F.when(text.isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(
        _spans(text, CANDIDATE % window, 3)))
    free = F.filter("all_spans", lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"])
                                                     & (s["start"] < b["end"])) & is_secret(s["value"], window, allow))
    return out.withColumn("all_spans", F.array_sort(F.concat("base_spans", free)))
