"""Secret scans: pattern kinds plus sliding-window entropy over candidate strings.

Spans are code-point offsets, end exclusive. Pattern kinds (``assign``,
``access``, ``hex``) are leftmost non-overlapping matches per kind. The entropy
kinds look at candidate strings, the maximal runs of a character class. A
window of ``WINDOW`` characters slides over a candidate; an aggregate holds the
count of each symbol in the window and the sum of ``c * log2(c)``, and updates
both for the symbol that enters and the one that leaves. The window's Shannon
entropy is ``log2(WINDOW) - sum / WINDOW``. Where a window reaches the class's
threshold, the stretch from the first to the last such window becomes a span,
unless the candidate has an allowed shape (slug or path, UUID, one character) or
the stretch lies inside a pattern span. Placeholder words and counting sequences
cut a candidate into parts, each judged as a candidate of its own: only the
windows that hold or touch such a word are left out.

Everything is a column expression: no Python on the executors, no shuffle, and
documents without a match skip the array work. A text of any length is scanned
whole.

Defined results: a null text is scanned as the empty text and has no spans;
spans that start together are ordered by kind; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern kinds. Short runs of ``access`` and ``hex`` can't
# hide a longer match of their kind, so their least length is in the pattern;
# a short ``assign`` match does take its text, so it is dropped afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper"]

WINDOW = 20
# Character classes of the entropy kinds: run, alphabet, what a candidate must
# hold, least window entropy in bits.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdef", [r"[0-9]", r"[A-Fa-f]"], 2.9),
    "entropy_base64": (
        r"[A-Za-z0-9+/_=-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=",
        [r"[0-9]", r"[A-Z]", r"[a-z]"],
        3.8,
    ),
    # 36 and fewer symbols: random windows have some 3.8 bits, so less is asked
    "entropy_lower": (r"[a-z0-9]{20,}", "abcdefghijklmnopqrstuvwxyz0123456789", [r"[0-9]", r"[a-z]"], 3.5),
    "entropy_upper": (r"[A-Z0-9]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", [r"[0-9]", r"[A-Z]"], 3.5),
}
ALLOW = [
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|1234567890|abcdefghij",
    r"^(.)\1*$",
]
WORDS = ALLOW[2]  # may stand anywhere; the others are the shape of a whole candidate
CUT = "(?i).?(?:" + WORDS.removeprefix("(?i)") + ").?"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found>> of all matches; found is the group.

    The text between the matches comes from a split, so each start is the
    length of all pieces and matches before it.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"),
    )
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["all"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("out"))

    walked = F.aggregate(
        F.filter(parts, lambda x: x["all"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]
    )
    return F.when(text.rlike(pattern), walked).otherwise(none)


def hot_stretch(symbols: Column, alphabet: int, least: float) -> Column:
    """struct<lo, hi>: from the first to the last window whose entropy is ``least`` or more; hi is 0 if there is none.

    ``symbols``: the candidate as an array of numbers from 1 to ``alphabet``.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    most = (math.log2(WINDOW) - least) * WINDOW + 1e-9  # entropy >= least, as a bound on the sum

    def slide(acc: Column, i: Column) -> Column:
        come = F.get(symbols, i)
        gone = F.when(i >= WINDOW, F.get(symbols, i - WINDOW)).otherwise(0)
        more, less = F.get(acc["count"], come), F.get(acc["count"], gone)
        change = F.when(come == gone, 0.0).otherwise(
            F.get(weight, more + 1) - F.get(weight, more) + F.when(gone == 0, 0.0).otherwise(F.get(weight, less - 1) - F.get(weight, less))
        )
        count = F.transform(
            acc["count"], lambda c, k: c + (k == come).cast("int") - ((k == gone) & (gone > 0)).cast("int")
        )
        return F.struct(count.alias("count"), (acc["sum"] + change).alias("sum"), acc["lo"].alias("lo"), acc["hi"].alias("hi"), i.alias("i"))

    def judge(acc: Column) -> Column:
        hot = (acc["i"] >= WINDOW - 1) & (acc["sum"] <= most)
        return F.struct(
            acc["count"].alias("count"),
            acc["sum"].alias("sum"),
            F.when(hot, F.least(acc["lo"], acc["i"] - (WINDOW - 1))).otherwise(acc["lo"]).alias("lo"),
            F.when(hot, acc["i"] + 1).otherwise(acc["hi"]).alias("hi"),
            acc["i"].alias("i"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), alphabet + 1).alias("count"),
        F.lit(0.0).alias("sum"),
        F.lit(2**31 - 1).alias("lo"),
        F.lit(0).alias("hi"),
        F.lit(-1).alias("i"),
    )
    # an array of one holds each step's state, so that it is computed once
    return F.aggregate(
        F.sequence(F.lit(0), F.size(symbols) - 1),
        start,
        lambda acc, i: F.get(F.transform(F.array(slide(acc, i)), judge), 0),
        lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")),
    )


def parts(x: Column) -> Column:
    """A candidate's parts between placeholder words, without the characters that touch one."""
    pairs = F.arrays_zip(F.split(x["found"], CUT, -1).alias("part"), F.regexp_extract_all(x["found"], F.lit(CUT), F.lit(0)).alias("cut"))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.char_length(p["part"])
        part = F.struct(acc["at"].alias("start"), end.alias("end"), p["part"].alias("found"))
        return F.struct((end + F.coalesce(F.char_length(p["cut"]), F.lit(0))).alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))

    walked = F.aggregate(pairs, F.struct(x["start"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(x["found"].rlike(WORDS), walked).otherwise(F.array(x))


def candidates(text: Column, kind: str) -> Column:
    """The candidate strings of a class, or their parts, that the allow list doesn't suppress."""
    run, _, must, _ = CLASSES[kind]

    def wanted(x: Column) -> Column:
        ok = F.char_length(x["found"]) >= WINDOW
        for p in must:
            ok = ok & x["found"].rlike(p)
        for p in ALLOW:
            ok = ok & ~x["found"].rlike(p)
        return ok

    return F.filter(F.flatten(F.transform(matches(text, run), parts)), wanted)


def entropy_spans(found: Column, kind: str) -> Column:
    """array<struct<start, end, found>> of the hot stretches of candidates."""
    _, alphabet, _, least = CLASSES[kind]

    def stretch(x: Column) -> Column:
        s = F.lower(x["found"]) if kind == "entropy_hex" else x["found"]
        numbers = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c))
        return F.struct(x["start"].alias("start"), x["found"].alias("found"), F.filter(numbers, lambda k: k > 0).alias("symbols"))

    def judged(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["found"].alias("found"), hot_stretch(x["symbols"], len(alphabet), least).alias("hot"))

    hot = F.filter(F.transform(F.transform(found, stretch), judged), lambda x: x["hot"]["hi"] > 0)
    return F.transform(hot, lambda x: F.struct((x["start"] + x["hot"]["lo"]).alias("start"), (x["start"] + x["hot"]["hi"]).alias("end"), x["found"].alias("found")))


def of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, [text,] base and spans: arrays of struct<start, kind (number in KINDS), end>, sorted."""
    t = F.col("text")
    step = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    step = step.withColumns(
        {
            "assign": F.filter(matches(t, ASSIGN, 2), lambda x: F.char_length(x["found"]) >= ASSIGN_LEAST),
            "access": matches(t, ACCESS),
            "hex": matches(t, HEX),
        }
        | {k: candidates(t, k) for k in CLASSES}
    )
    step = step.select(
        "doc_id",
        *["text"] * keep_text,
        F.array_sort(F.concat(*[of_kind(F.col(k), k) for k in KINDS[:3]])).alias("base"),
        F.concat(*[of_kind(entropy_spans(F.col(k), k), k) for k in CLASSES]).alias("more"),
    )
    base = F.col("base")
    added = F.filter("more", lambda m: ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    return step.withColumn("spans", F.array_sort(F.concat(base, added))).drop("more")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mask`` (overlapping spans by one); others unchanged."""
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    found = scan(docs.select(whole.alias("doc_id"), "text"), keep_text=True)

    def cover(acc: Column, x: Column) -> Column:
        gap = F.col("text").substr(acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    masked = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        cover,
        lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.char_length("text"))),
    )
    found = found.withColumn("masked", F.when(F.size("spans") > 0, masked))
    new = {"text": F.coalesce(F.col("masked"), F.col("doc_id.text")), "n_chars": F.when(F.col("masked").isNull(), F.col("doc_id.n_chars")).otherwise(F.char_length("masked").cast("long"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"doc_id.`{c}`").alias(c) for c in columns])


def query(docs: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    n = {f"n_{k}": count(i) for i, k in enumerate(KINDS[:3])}
    return scan(docs).select(
        "doc_id",
        *[c.alias(k) for k, c in n.items()],
        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
