"""Text functions as column expressions. All run in the JVM; none is a Python UDF.

Where the semantics are Python's, regular expressions carry (?U), as Java's \\w and \\s are ASCII by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, and the stop words of content-word functions.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with"]


def bound(values: list[Column], body) -> Column:
    """body(values) with each value computed once a row, also where body's own functions use it for every element."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.element_at(F.transform(held, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), 1)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def exact_match(a: Column, b: Column) -> Column:
    return (normalize_answer(a) == normalize_answer(b)).cast("int")


def words(text: Column) -> Column:
    """Of a text with single spaces."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many tokens two arrays share, each as often as both have it."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the normalized tokens as multisets; two empty answers agree."""

    def f1(p: Column, g: Column) -> Column:
        return bound([multiset_overlap(p, g)], lambda same: F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g))))

    return bound([words(normalize_answer(prediction)), words(normalize_answer(gold))], f1)


def supporting_recall(gold: Column, retrieved: Column) -> Column:
    """Share of gold, duplicates counted, that was retrieved; 0 without gold."""
    return F.when(F.size(gold) > 0, F.size(F.filter(gold, lambda x: F.array_contains(retrieved, x))) / F.size(gold)).otherwise(0.0)


def answer_set(text: Column) -> Column:
    """The distinct normalized answers of a list separated by commas, semicolons, slashes, lines or `and`."""
    parts = F.split(text, r",|;|/|\n|\band\b")
    return F.array_distinct(F.filter(F.transform(parts, normalize_answer), lambda x: x != ""))


def hits_at_1(prediction: Column, gold: Column) -> Column:
    first = F.get(answer_set(prediction), F.lit(0))
    return F.coalesce(F.array_contains(answer_set(gold), first), F.lit(False)).cast("int")


def set_f1(prediction: Column, gold: Column) -> Column:
    p, g = answer_set(prediction), answer_set(gold)
    same = F.size(F.array_intersect(p, g))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def content_words(text: Column) -> Column:
    """Distinct tokens of three characters or more that aren't stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def groundedness(answer: Column, evidence: Column) -> Column:
    """Share of the answer's content words that the evidence has; 1 for an empty answer, 0 without evidence."""
    a, e = content_words(answer), content_words(evidence)
    return F.when(F.size(a) == 0, 1.0).when(F.size(e) == 0, 0.0).otherwise(F.size(F.array_intersect(a, e)) / F.size(a))


def covered(fact: Column, answer: Column, threshold: float = 0.6) -> Column:
    """Whether enough of a fact's content words are in the answer; a fact without any never is."""
    f = content_words(fact)
    return (F.size(f) > 0) & (F.size(F.array_intersect(f, content_words(answer))) >= threshold * F.size(f))


def token_overlap(q: Column, d: Column) -> Column:
    """Share of the query's distinct tokens that the document has; 0 for an empty query."""
    a, b = F.array_distinct(tokens(q)), F.array_distinct(tokens(d))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def node_id_key(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", "_")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the alphanumeric key, padded by two spaces on each side."""
    padded = F.concat(F.lit("  "), alnum_key(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Borders of words, also beside letters outside ASCII; \b differs between engines there.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def title_runs(text: Column) -> Column:
    """Runs of capitalised words longer than three characters, each once whatever its case; the first spelling stays."""
    found = F.filter(F.regexp_extract_all(text, F.lit(BEGIN + "[A-Z][a-z]+(?: [A-Z][a-z]+)*" + END), 0), lambda x: F.length(x) > 3)
    entries = F.array_sort(F.transform(found, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = bound([entries], lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["k"] != x["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def wiki_links(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]]."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)


def tickets(text: Column, stop: tuple[str, ...] = ("UTF", "ISO", "RFC", "SHA", "HTTP", "COVID")) -> Column:
    found = F.regexp_extract_all(text, F.lit(BEGIN + r"([A-Z][A-Z0-9]{1,9}-\d{1,6})" + END), 1)
    return F.array_distinct(F.filter(found, lambda x: ~F.substring_index(x, "-", 1).isin(*stop)))


def speakers(text: Column, stop: tuple[str, ...] = ("http", "https", "note", "todo"), chars: int = 4000) -> Column:
    """Names that begin a line and end in a colon, in the text's opening."""
    found = F.regexp_extract_all(F.substring(text, 1, chars), F.lit(r"(?m)^([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){0,2}):"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(x).isin(*stop)))


def candidate_spans(text: Column, most: int = 4) -> Column:
    """Pieces between commas, semicolons and lines without bullets and numbers, of at most `most` words."""
    parts = F.transform(F.split(text, "[,;\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s*\-0-9.)]+", "")))
    return F.filter(parts, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= most))


def json_array(text: Column) -> Column:
    """From the first [ to the last ], code fences stripped; null if there is none."""
    bare = F.regexp_replace(text, "```(?:json)?", "")
    begin, end = F.instr(bare, "["), F.length(bare) - F.instr(F.reverse(bare), "]") + 1
    return F.when((begin > 0) & (F.instr(bare, "]") > 0) & (end > begin), F.substring(bare, begin, end - begin + 1))


def canonical_relation(rel: Column, typos: dict[str, str]) -> Column:
    key = F.regexp_replace(F.lower(F.trim(rel)), r"\s+", "_")
    fixed = F.create_map(*[F.lit(x) for kv in typos.items() for x in kv])
    return F.coalesce(F.element_at(fixed, key), key)


def hash_bucket(token: Column, width: int = 384) -> tuple[Column, Column]:
    """Bucket and sign of a token: the first four bytes of its SHA-256, little-endian, and the fifth one's parity."""
    h = F.sha2(token, 256)
    little = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    bucket = F.conv(little, 16, 10).cast("long") % width
    return bucket, F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)


def sentence_chunks(text: Column, chunk_words: int = 256, overlap: int = 32) -> Column:
    """Chunks of whole sentences of at most chunk_words words, each beginning with the last sentences, of at most `overlap` words, of the one before. A longer sentence is its own chunk."""
    whole = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    sentences = F.transform(whole, lambda s: F.struct(s.alias("s"), F.size(F.split(s, r"\s+")).alias("n")))  # each sentence's words are counted once
    some, none = F.array().cast("array<struct<s:string,n:int>>"), F.array().cast("array<string>")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), " ")

    def tail(xs: Column) -> Column:
        """The last sentences within the overlap, and their words."""
        zero = F.struct(some.alias("now"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def step(a: Column, s: Column) -> Column:
            on = a["on"] & (a["n"] + s["n"] <= overlap)
            return F.struct(F.when(on, F.concat(F.array(s), a["now"])).otherwise(a["now"]).alias("now"), F.when(on, a["n"] + s["n"]).otherwise(a["n"]).alias("n"), on.alias("on"))

        return F.aggregate(F.reverse(xs), zero, step, lambda a: F.struct(a["now"].alias("now"), a["n"].alias("n")))

    def add(a: Column, s: Column) -> Column:
        full = (F.size(a["at"]["now"]) > 0) & (a["at"]["n"] + s["n"] > chunk_words)
        done = F.when(full, F.concat(a["done"], F.array(joined(a["at"]["now"])))).otherwise(a["done"])
        with_s = lambda at: F.struct(F.concat(at["now"], F.array(s)).alias("now"), (at["n"] + s["n"]).alias("n"))
        return F.struct(done.alias("done"), F.when(full, bound([tail(a["at"]["now"])], with_s)).otherwise(with_s(a["at"])).alias("at"))

    begin = F.struct(none.alias("done"), F.struct(some.alias("now"), F.lit(0).alias("n")).alias("at"))
    return F.aggregate(sentences, begin, add, lambda a: F.when(F.size(a["at"]["now"]) > 0, F.concat(a["done"], F.array(joined(a["at"]["now"])))).otherwise(a["done"]))


def word_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of `size` words, each beginning size - overlap after the one before, the last one shorter; no window holds only what the one before it had."""
    def cut(w: Column) -> Column:
        last = F.greatest(F.size(w) - overlap - 1, F.lit(0))
        starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
        return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(F.filter(F.split(text, r"\s+"), lambda x: x != "")), cut), 1)
