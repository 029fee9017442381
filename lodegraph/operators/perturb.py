"""False variants of facts and degraded names, by choices that a digest of the fact makes.

A replacement is drawn by its number: names are numbered so that those which may not be drawn, the replaced
one and those that only the fact itself has, are one number and one stretch of numbers, which the draw steps over. So
every fact finds its replacement by equi-joins; no pool is collected and no pair of facts is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import BEGIN, END
from lodegraph.operators.durable import kept, numbered

#: What a name looks like and what is none, and statements with what denies them.
NAME = r"[A-Z][a-zA-Z]{3,}"
NUMBER = r"\d+(?:\.\d+)?"
NO_NAMES = ["the", "this", "that", "these", "there", "when", "what"]
NEGATABLE = [(" is ", " is not "), (" are ", " are not "), (" was ", " was not "), (" will ", " will not "), (" can ", " cannot "), (" has ", " has no "), (" does ", " does not "), (" must ", " must not ")]
KINDS = ["numeric", "entity", "negation", "swap"]
#: A number of more characters isn't changed: five times it may not be exact.
DIGITS = 15


def draw(seed: Column, salt: str) -> Column:
    """A number below 2**32 from a digest."""
    return F.conv(F.substring(F.md5(F.concat(seed, F.lit(salt))), 1, 8), 16, 10).cast("long")


def replaced(text: Column, old: Column, new: Column) -> Column:
    """text with the first `old` in it replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def names_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"{BEGIN}{NAME}{END}"), 0)
    return F.filter(found, lambda x: ~F.lower(x).isin(NO_NAMES))


def numeric(text: Column, seed: Column) -> Column:
    """One number of the text, five times as large and seven more, with a decimal if it had a fraction; null without a number."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"{BEGIN}{NUMBER}{END}"), 0), lambda x: F.length(x) <= DIGITS)
    target = F.get(found, F.pmod(draw(seed, "number"), F.greatest(F.size(found), F.lit(1))).cast("int"))
    value = target.cast("double")
    more = value * 5 + 7
    new = F.when(value == F.floor(value), more.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.format_number(more, 1), ",", ""))
    return replaced(text, target, new)


def negated(text: Column) -> Column:
    """The first statement, in the order of NEGATABLE, denied; null without one."""
    return F.coalesce(*[replaced(text, F.lit(a), F.lit(b)) for a, b in NEGATABLE])


def entities(facts: DataFrame) -> DataFrame:
    """(fact_id, entity) for facts (fact_id, text): the text with one of its names replaced by another one that some other fact has; without such a pair no row."""
    seed = F.col("fact_id").cast("string")
    held = kept(facts.select("fact_id", "text", names_in(F.col("text")).alias("names")))
    owners = held.select("fact_id", F.explode("names").alias("name")).groupBy("name").agg(F.min("fact_id").alias("first"), F.max("fact_id").alias("last"))
    owned = F.when(F.col("first") == F.col("last"), F.col("first"))  # the only fact that has the name
    pool = kept(numbered(owners.select("name", owned.isNotNull().alias("single"), owned.alias("owner")), ["single", "owner", "name"]).select("name", "owner", "number"))
    total = pool.agg(F.count(F.lit(1)).alias("total"))
    own = pool.where("owner is not null").groupBy(F.col("owner").alias("fact_id")).agg(F.min("number").alias("begin"), F.count(F.lit(1)).alias("width"))
    pick = F.get("names", F.pmod(draw(seed, "name"), F.greatest(F.size("names"), F.lit(1))).cast("int"))
    asked = held.where("size(names) > 0").select("fact_id", "text", pick.alias("name"))
    placed = asked.join(pool.select("name", F.col("number").alias("at"), F.col("owner").isNotNull().alias("inside")), "name").join(own, "fact_id", "left").join(F.broadcast(total))  # one row
    # numbers to step over: the fact's own stretch, or else the name's number as well
    width, begin = F.coalesce("width", F.lit(0)), F.coalesce("begin", F.col("total"))
    free = F.col("total") - width - F.when(F.col("inside"), 0).otherwise(1)
    drawn = placed.withColumn("free", free).where("free > 0").withColumn("r", F.pmod(draw(seed, "other"), F.greatest(F.col("free"), F.lit(1))))
    # a name that others have too stands before every owned one
    stepped = F.when(~F.col("inside") & (F.col("r") >= F.col("at")), F.col("r") + 1).otherwise(F.col("r"))
    number = F.when(stepped >= begin, stepped + width).otherwise(stepped)
    chosen = drawn.select("fact_id", "text", "name", number.alias("number")).join(pool.select("number", F.col("name").alias("other")), "number")
    return chosen.select("fact_id", replaced(F.col("text"), F.col("name"), F.col("other")).alias("entity"))


def grafted(facts: DataFrame) -> DataFrame:
    """(fact_id, swap): the first half of each fact's words with the second half of another fact's, if both have more than six."""
    places = kept(numbered(facts.select("fact_id", "text"), ["fact_id", "text"]))
    total = places.agg(F.count(F.lit(1)).alias("total"))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    step = F.pmod(draw(F.col("fact_id").cast("string"), "graft"), F.greatest(F.col("total") - 1, F.lit(1))) + 1
    asked = places.join(F.broadcast(total)).where("total > 1").select("fact_id", words("text").alias("a"), F.pmod(F.col("number") + step, F.col("total")).alias("number"))  # one row
    both = asked.join(places.select("number", words("text").alias("b")), "number").where("size(a) > 6 and size(b) > 6")
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    return both.select("fact_id", F.array_join(F.concat(F.slice("a", 1, half("a")), F.slice("b", half("b") + 1, F.size("b"))), " ").alias("swap"))


def variants(facts: DataFrame) -> DataFrame:
    """facts (fact_id once each, text) with numeric, entity, negation and swap, null where the kind doesn't apply, and kind and variant: the first that does, in an order that a digest of the fact gives."""
    seed = F.col("fact_id").cast("string")
    found = facts.select("fact_id", "text", numeric(F.col("text"), seed).alias("numeric"), negated(F.col("text")).alias("negation"))
    every = found.join(entities(facts), "fact_id", "left").join(grafted(facts), "fact_id", "left")
    order = F.array_sort(F.array(*[F.struct(draw(seed, k).alias("o"), F.lit(k).alias("kind"), F.col(k).alias("variant")) for k in KINDS]))
    first = F.get(F.filter(order, lambda x: x["variant"].isNotNull()), F.lit(0))
    return every.select("fact_id", "text", *KINDS, first["kind"].alias("kind"), first["variant"].alias("variant"))


DEGRADED = ["exact", "lowercase", "char_swap", "char_drop", "char_double", "truncated"]


def degraded(name: Column, kind: str, seed: Column) -> Column:
    """A name as it may be misspelt: two characters inside swapped, one dropped or doubled, the last quarter cut off. Short names stay."""
    n = F.length(name)

    def at(end: int) -> Column:
        """A place from 1 to n - end - 1, in characters from 0."""
        return (F.pmod(draw(seed, kind), F.greatest(n - end - 1, F.lit(1))) + 1).cast("int")

    part = lambda a, b: F.substring(name, a + 1, b - a)
    if kind == "exact":
        return name
    if kind == "lowercase":
        return F.lower(name)
    if kind == "char_swap":
        i = at(2)
        return F.when(n < 4, name).otherwise(F.concat(part(F.lit(0), i), part(i + 1, i + 2), part(i, i + 1), part(i + 2, n)))
    if kind == "char_drop":
        i = at(1)
        return F.when(n < 4, name).otherwise(F.concat(part(F.lit(0), i), part(i + 1, n)))
    if kind == "char_double":
        i = at(1)
        return F.when(n < 3, name).otherwise(F.concat(part(F.lit(0), i), part(i, i + 1), part(i, n)))
    if kind == "truncated":
        return F.substring(name, F.lit(1), F.greatest(F.lit(4), F.floor(n * 3 / 4).cast("int")))
    raise ValueError(kind)


def renamed(name: Column, kind: str) -> Column:
    """A name of several words as its last one, or with initials before that; others stay."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    last = F.element_at(words, -1)
    if kind == "surname":
        return F.when(F.size(words) > 1, last).otherwise(name)
    if kind == "initials":
        return F.when(F.size(words) > 1, F.concat_ws(" ", F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), last)).otherwise(name)
    raise ValueError(kind)
