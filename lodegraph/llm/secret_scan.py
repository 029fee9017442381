r"""Secret scans: fixed patterns, and candidate strings of high local entropy. DataFrame functions only.

A pattern's places come from its matches and the pieces between them, whose
lengths add up to code points. The entropy scan takes all strings of 20 characters of
keys or more; each belongs to a class (hexadecimal, lower-case letters with digits, letters of one case,
no digits, or the whole base64 alphabet) with a window width and a threshold in bits; words run
together need a higher one than keys do. The window slides by
one character at a time: two counts change, and the sum of c*log2(c) with them. The counts of
all characters lie in a few long integers, PACKED to one, so a change is one addition. A
string whose densest window reaches its class's threshold is a finding unless the
allow-list knows it: placeholders, UUIDs, hashes of the empty input, alphabets,
numbers, and, where the text before it shows one, parts of addresses and paths.

Defined cases: a null text is as an empty one; findings of one place are ordered by
kind; repeated rows are scanned each; columns with the names of outputs are
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import fresh, let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, and the least length of the match or, for assignments, of the value.
BASE = [("assign", ASSIGN, 6), ("access", r"AKIA[A-Z0-9]{16,}", 20), ("hex", r"[0-9a-f]{24,}", 24)]
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: class, what its strings look like, window width, bits that make a finding.
CLASSES = [
    ("hex", "^[0-9a-fA-F]+$", 16, 2.9),
    ("letters", "^(?:[a-z]+|[A-Z]+)$", 24, 3.85),
    ("words", "^[A-Za-z+/_=-]+$", 24, 4.2),
    ("lower", "^[0-9a-z]+$", 20, 3.6),
    ("base64", "", 20, 3.8),
]
#: Characters of a part that is judged on its own.
PART = 20
#: Counts to a long integer and bits of each; the first character's code. Windows are shorter than 2**BITS.
PACKED, BITS, FIRST, LAST = 12, 5, ord("+"), ord("z")
#: c*log2(c) of every count.
WEIGHTS = [0.0, *[c * log2(c) for c in range(1, 2**BITS)]]
#: Strings that are no secrets. A flag holds for its own alternative only.
ALLOWED = "|".join([
    "(?i:example)", "(?i:sample)", "(?i:dummy)", "(?i:changeme)", "(?i:placeholder)", "(?i:your[_-])", "(?i:xxxx)",
    "(?i:^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)",
    "^[0-9_/+-]+=*$",
    "(?i:abcdefgh)", "012345678", "(?i:qwertyuiop)",
    "(?i:^d41d8cd98f00b204e9800998ecf8427e$)", "(?i:^da39a3ee5e6b4b0d3255bfef95601890afd80709$)",
    "(?i:^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$)",
])
#: How a part of an address or path begins, and how the text before it must end: a scheme, a host's labels, a folder.
PLACES = [
    ("^//", r"(?<![A-Za-z0-9+.-])(?i:https?|ftps?|sftp|wss?|s3a?|gs|hdfs|file|git|ssh|svn)(?:\+[a-z]+)?:$"),
    ("^[a-z]{2,}/[a-z]", r"(?:^|[\s/@\"'(<\[])(?:[A-Za-z0-9-]+\.)+$"),
    ("^/[a-z]+/[a-z]", r"(?:^|[\s\"'(<\[=:,])(?:~|\.{1,2}|\$[A-Za-z_]+|\$\{[A-Za-z_]+\})$"),
]
#: Characters before a candidate that are looked at.
BEFORE = 80
KINDS = ["assign", "access", "hex", "entropy"]
SPAN = "array<struct<s:int,k:int,e:int>>"


def _places(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (s, k, e) of the matches for which keep(match, text since the match before last) holds, from the lengths of pieces and matches."""
    none = F.array().cast(SPAN)

    def walk(pieces: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + F.length(x["p"])
            e = s + F.length(x["m"])
            span = F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"))
            return F.struct(e.alias("at"), x["m"].alias("last"), F.when(keep(x["m"], F.concat(a["last"], x["p"])), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(pairs, begin, step, lambda a: a["out"])

    return F.when(text.rlike(pattern), let(text, lambda t: walk(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 0)))).otherwise(none)


def densest(string: Column, width: int | Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of `width` characters of keys; of the whole string if it is shorter."""
    weights, w = F.array(*[F.lit(x) for x in WEIGHTS]), width if isinstance(width, Column) else F.lit(width)
    # a character's place: which long integer, and how far its count is shifted
    place = lambda c: let(F.ascii(c) - FIRST, lambda x: F.struct(F.floor(x / PACKED).cast("int").alias("k"), (x % PACKED * BITS).alias("s")))
    count = lambda n, x: F.call_function("shiftrightunsigned", F.get(n, x["k"]), x["s"]).bitwiseAND(2**BITS - 1).cast("int")
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["s"])
    weight = lambda c: F.element_at(weights, c + 1)
    entropy = lambda total, held: F.log2(held) - total / held

    def slide(codes: Column) -> Column:
        empty = F.array_repeat(F.lit(0).cast("long"), (LAST - FIRST) // PACKED + 1)
        zero = F.struct(empty.alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(a: Column, i: Column) -> Column:
            new, old = F.element_at(codes, i), F.get(codes, i - w - 1)
            grown, shrunk = count(a["n"], new), count(a["n"], old)
            added, taken = weight(grown + 1) - weight(grown), weight(shrunk - 1) - weight(shrunk)
            total = F.when(i <= w, a["sum"] + added).when(old == new, a["sum"]).otherwise(a["sum"] + added + taken)
            counts = F.transform(a["n"], lambda c, k: c + F.when(k == new["k"], one(new)).otherwise(0) - F.when((i > w) & (k == old["k"]), one(old)).otherwise(0))
            # the window before this step counts if it was full
            best = F.when(i > w, F.greatest(a["best"], entropy(a["sum"], w.cast("double")))).otherwise(a["best"])
            return F.struct(counts.alias("n"), total.alias("sum"), best.alias("best"))

        last = lambda a: F.greatest(a["best"], entropy(a["sum"], F.least(F.size(codes), w).cast("double")))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, last)

    return let(F.transform(F.filter(F.split(string, ""), lambda c: c != ""), place), slide)


def _in_place(match: Column, before: Column) -> Column:
    """Whether the candidate is a part of an address or path that the text before it shows."""
    end = F.right(before, F.lit(BEFORE))
    return reduce(Column.__or__, [match.rlike(begins) & end.rlike(shows) for begins, shows in PLACES])


def _limits(string: Column) -> Column:
    """Width and bits of the string's class; it is chosen first, so that one loop over the string follows."""
    pairs = [(look, F.struct(F.lit(width).alias("width"), F.lit(bits).alias("bits"))) for _, look, width, bits in CLASSES]
    chosen = F.when(string.rlike(pairs[0][0]), pairs[0][1])
    for look, limits in pairs[1:-1]:
        chosen = chosen.when(string.rlike(look), limits)
    return chosen.otherwise(pairs[-1][1])


def _is_mixed(string: Column) -> Column:
    return string.rlike("[a-z]") & string.rlike("[A-Z]") & string.rlike("[0-9]")


def _telling(match: Column, before: Column) -> Column:
    """Whether the candidate, or a part of it between / _ and -, reaches its class's threshold, and the allow-list doesn't know it.

    Parts are judged by their own class, so that a prefix doesn't raise a key's threshold, nor a word of the allow-list before it hide it. Of a part of an address or path
    only parts of both cases and digits are judged.
    """
    parts = F.filter(F.split(match, "[/_-]+"), lambda x: F.length(x) >= PART)
    asked = lambda placed: F.when(placed, F.filter(parts, _is_mixed)).otherwise(F.array_distinct(F.concat(F.array(match), parts)))
    tells = lambda x: ~x.rlike(ALLOWED) & let(_limits(x), lambda c: densest(x, c["width"]) >= c["bits"])
    return F.exists(let(_in_place(match, before), asked), tells)


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans, arrays of (s, k, e): code points from s to before e, k the place in KINDS."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base_spans", "spans")])
    keep = {"assign": lambda m, before: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6}
    base = [_places(text, pattern, kind, keep.get(kind, lambda m, before, n=least: F.length(m) >= n)) for kind, pattern, least in BASE]
    own = fresh(kept, "_entropy")
    found = kept.withColumns({"base_spans": F.sort_array(F.concat(*base)), own: _places(text, CANDIDATE, "entropy", _telling)})
    return found.withColumn("spans", F.sort_array(F.concat("base_spans", own))).drop(own)


def digests(scanned: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans as text."""
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == KINDS.index(k))).cast("long")
    return scanned.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
