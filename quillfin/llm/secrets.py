"""Secret scans in DataFrame functions only.

Base kinds are regular expressions. The added kind ``entropy`` looks at candidate
strings per character class: a window slides over a candidate, the counts of its
characters are updated by the one that leaves and the one that enters, and so is
the sum of c log2 c from which the window's Shannon entropy follows. A candidate whose
largest window entropy reaches its class's limit is reported unless an allow-list
pattern fits it or a base span overlaps it.

Texts without any match never leave the quick ``rlike`` tests. Null texts count as
empty; nulls elsewhere, repeated rows and extra columns pass through; an empty table gives an empty
result. Spans count code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Pattern, group whose length counts, least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # runs are maximal, so asking for the length at once finds the same ones
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WINDOW = 20
#: Character classes: candidates (maximal runs) and the least window entropy in bits.
CLASSES = {
    "hex": (r"(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{20,}", 3.0),
    # one case and digits in several places, not all of them hexadecimal
    "upper": (r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9]+[A-Z]+[0-9])(?=[A-F0-9]*[G-Z])[A-Z0-9]{20,}+(?![a-z])", 3.6),
    "lower": (r"(?<![A-Za-z0-9])(?=[a-z]*[0-9]+[a-z]+[0-9])(?=[a-f0-9]*[g-z])[a-z0-9]{20,}+(?![A-Z])", 3.6),
    "base64": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}", 3.7),
}
#: Never secrets: identifiers with hyphens in the places of a UUID, paths of words, alphabets, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([A-Za-z]+|[0-9]+)([/_=-]+([A-Za-z]+|[0-9]+))+/?$",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"(?i)example|placeholder|xxxx|changeme",
)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, op) -> Column:
    """The array's running totals under ``op`` (of non-negative integers), itself included, for each element.

    Appending copies an array, so it is done within chunks of 64 and over chunk totals.
    """
    none = F.expr("cast(array() as array<int>)")

    def within(chunk):
        return F.aggregate(chunk, none, lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x))))

    def across(inner):
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        before = F.aggregate(inner, start, lambda acc, c: F.struct(op(acc["at"], F.element_at(c, -1)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return let(before, lambda b: F.flatten(F.transform(inner, lambda c, i: F.transform(c, lambda x: op(F.get(b, i), x)))))

    def cut(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), lambda k: F.slice(v, k * 64 + 1, F.lit(64)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.transform(cut(v), within), across)).otherwise(none))


def plus(a, b):
    return a + b


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e, v>> of the pattern's matches, leftmost and not overlapping,
    whose group has at least so many characters: places follow from the pieces between matches."""
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if "(" in pattern else F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def placed(rows):
        ends = running(F.transform(rows, lambda x: F.char_length(x["p"]) + F.coalesce(F.char_length(x["h"]), F.lit(0))), plus)
        good = F.filter(F.arrays_zip(ends.alias("e"), rows.alias("r")), lambda x: F.coalesce(F.char_length(x["r"]["g"]) >= least, F.lit(False)))
        return F.transform(good, lambda x: F.struct((x["e"] - F.char_length(x["r"]["h"])).alias("s"), x["e"].alias("e"), x["r"]["h"].alias("v")))

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), hits.alias("h"), sized.alias("g"))
    return F.when(text.rlike(pattern), let(zipped, placed)).otherwise(empty)


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of the windows of an ASCII string; 0 if it is shorter than one.

    The sum of c log2 c over a window's characters follows from that of the window before: only the counts of the
    character that leaves and of the one that enters change.
    """

    def f(c):
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def largest(codes):
        def step(acc, i):
            kept = F.slice(codes, F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1)))  # what both windows have
            enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window))

            def moved(c):
                into = F.size(F.filter(c, lambda x: x == enters))
                out = F.size(F.filter(c, lambda x: x == leaves))
                total = acc["t"] + F.when(i >= window, f(out) - f(out + 1)).otherwise(F.lit(0.0)) + f(into + 1) - f(into)
                return F.struct(total.alias("t"), F.when(i >= window - 1, F.greatest(acc["b"], F.log2(F.lit(float(window))) - total / window)).otherwise(acc["b"]).alias("b"))

            return let(kept, moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("b")), step)["b"]

    return F.round(let(F.transform(F.split(string, ""), lambda c: F.ascii(c)), largest), 6)


def spans_column(text: Column) -> tuple[Column, Column]:
    """(base spans by kind, entropy candidates): arrays of struct<s, k, e, name, v>, to be read in two steps; see ``scan``."""
    kinds = list(KINDS)

    def tagged(found: Column, k: int, name: str) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(name).alias("name"), x["v"].alias("v")))

    base = F.array_sort(F.concat(*(tagged(_found(text, *KINDS[n]), k, n) for k, n in enumerate(kinds))))
    more = F.concat(*(tagged(_found(text, p, 0, WINDOW), k, n) for k, (n, (p, _)) in enumerate(CLASSES.items())))
    return base, more


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` and an array ``spans_col`` of struct<s, k, e, name>, sorted: base kinds and ``entropy``.

    Columns of ``docs`` keep their names and places; ``spans_col`` must be a new name (see ``mask``).
    """
    if fresh(docs.columns, spans_col) != spans_col:
        raise ValueError(f"{spans_col} is taken")
    base = fresh([*docs.columns, spans_col], "base")
    more = fresh([*docs.columns, spans_col, base], "more")
    first, second = spans_column(F.coalesce(F.col(text_col), F.lit("")))
    limits = F.array(*(F.lit(x) for _, x in CLASSES.values()))
    allow = "|".join(f"(?:{p})" if not p.startswith("(?i)") else p.replace("(?i)", "(?i:") + ")" for p in ALLOW)

    def reported(x):
        apart = ~F.exists(F.col(base), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return ~x["v"].rlike(allow) & (window_entropy(x["v"]) >= F.get(limits, x["k"])) & apart

    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"], x["k"], x["e"], x["name"]))
    entropy = F.array_distinct(F.transform(F.filter(F.col(more), reported), lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e"), F.lit("entropy").alias("name"))))
    all_ = F.when(F.size(F.col(more)) > 0, F.array_sort(F.concat(slim(F.col(base)), entropy))).otherwise(slim(F.col(base)))
    return docs.withColumns({base: first, more: second}).withColumn(spans_col, all_).drop(base, more)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, masked; spans sorted by start."""

    def cut(own):
        reach = running(F.transform(own, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: pieces(own, r))

    def pieces(own, reach):
        # a span that begins where all before it have ended begins a run; text lies between runs
        gaps = F.filter(F.transform(own, lambda x, i: F.struct(F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("a"), x["s"].alias("b"), (i == 0).alias("first"))), lambda x: x["first"] | (x["b"] >= x["a"]))
        all_ = F.concat(gaps, F.array(F.struct(F.element_at(reach, -1).alias("a"), F.char_length(text).alias("b"), F.lit(False).alias("first"))))
        few = lambda: F.transform(all_, lambda g: F.substring(text, g["a"] + 1, g["b"] - g["a"]))
        # a substring is found by walking the text, so for many spans the text is taken apart once
        many = lambda: let(F.split(text, ""), lambda c: F.transform(all_, lambda g: F.array_join(F.slice(c, g["a"] + 1, g["b"] - g["a"]), "")))
        return F.array_join(F.when(F.size(own) <= 64, few()).otherwise(many()), mask)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, cut))


def mask(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in the text, and the number of characters, where there is such a column, set anew for rows with any. Null texts stay null."""
    name = fresh(docs.columns, "spans")
    found = scan(docs, text_col, name)
    text = F.when(F.col(text_col).isNotNull(), redacted(F.col(text_col), F.col(name)))
    out = found.withColumn(text_col, text)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.size(name) > 0, F.char_length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return out.drop(name)
