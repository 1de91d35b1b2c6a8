"""Personal data: base recognisers plus bootstrapped contextual extraction, in DataFrame functions only.

Base spans per kind are the leftmost non-overlapping matches of fixed patterns; matches that fail their check
are dropped without a retry. Quantifiers are written possessively and anchored at run starts (`\\G` admits a
match that starts where the last one ended), which accepts the same spans in linear time and without recursion.

The bootstrap: base entities are the seeds. Every identifier-like token (it holds a digit or an @) is an instance;
the word before it, with digits folded, is its lexical pattern (`^` at a text's begin). Spark scores the
pattern-instance graph over several rounds: a pattern's confidence is the smoothed mean score of its instances, an
instance's score the noisy-or of its patterns' confidences. Instances are generalised by shape. Patterns of high
confidence and enough distinct seeds (different words, however often they occur) then mark unseen identifiers, as
spans of kind `context`. Counts cover all documents.

Defined results: null text is empty and has no spans; documents are independent rows, so repeated ids give
repeated rows; an empty table gives no rows; extra columns are ignored. Offsets count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellumen.llm.common import table, written

#: Fixed values of the contract, with possessive quantifiers.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: An identifier-like token: a word that holds a digit or an @.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: The last word of a text.
LAST = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+\z"


def _found(text: Column, pattern: str, left: bool = False, block: int = 256) -> Column:
    """array<struct<s, e, m>>: all matches of pattern with offsets, from the pieces between the matches; with left
    also the word before each match: the last one of the gap, or else the match before, or else `^`. Offsets are
    added up inside blocks of matches and then over the blocks, so that the work is in proportion to the text: one
    array that grows by a match at a time is copied for each."""
    hits, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(g.alias("gap"), h.alias("hit")))
    if left:
        pairs = F.zip_with(pairs, F.concat(F.array(F.lit("^")), hits), lambda p, b: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), b.alias("before")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    kind = "struct<s:int,e:int,m:string,left:string>" if left else "struct<s:int,e:int,m:string>"
    zero = lambda of: F.struct(F.lit(0).alias("at"), F.array().cast(of).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        fields = [s.alias("s"), e.alias("e"), x["hit"].alias("m")]
        if left:
            word = F.regexp_extract(x["gap"], LAST, 1)
            fields.append(F.when(word == "", x["before"]).otherwise(word).alias("left"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(*fields))).alias("out"))

    def behind(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: x.withField("s", x["s"] + acc["at"]).withField("e", x["e"] + acc["at"]))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def joined(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(p), F.lit(block)), lambda i: F.aggregate(F.slice(p, i, F.lit(block)), zero(f"array<{kind}>"), add))
        whole = F.aggregate(blocks, zero(f"array<array<{kind}>>"), behind, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(p) > 0, whole).otherwise(F.array().cast(f"array<{kind}>"))

    # The lambda holds the pairs, so that they are made once.
    return F.get(F.transform(F.array(pairs), joined), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """True if the digits of m pass the Luhn check."""
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.struct(F.try_to_number(c, F.lit("9")).cast("int").alias("v"), i.alias("i")))
    doubled = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(d, F.lit(0), lambda acc, x: acc + F.coalesce(F.when(x["i"] % 2 == 1, doubled(x["v"])).otherwise(x["v"]), F.lit(0)))
    return total % 10 == 0


def _ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans array<struct<s, e, m>> per kind, each behind a cheap test so that most texts skip the patterns."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    digit = text.rlike("[0-9]")
    need = {
        "email": F.contains(text, F.lit("@")),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.contains(text, F.lit("+")) & digit,
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

    def checked(kind: str) -> Column:
        return F.filter(_found(text, patterns[kind]), lambda x: _ok(kind, x["m"]))

    return {k: F.when(need[k], checked(k)).otherwise(none) for k in KINDS}


def spans(docs: DataFrame) -> DataFrame:
    """doc rows with `text` made non-null and one array column per base kind, named b_<kind>."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumns({f"b_{k}": v for k, v in base_spans(F.col("text")).items()})


def _shape(m: Column) -> Column:
    """Digits to 9, lower case to a, upper case to A, runs collapsed."""
    m = F.translate(m, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "a" * 26 + "A" * 26)
    return F.regexp_replace(F.regexp_replace(m, "9++", "9"), "[aA9]{3,}+", "x9")


def instances(found: DataFrame) -> DataFrame:
    """One row per identifier-like token: rid, s, e, pattern, shape, seed (it overlaps a base span), value (hash)."""
    text = F.col("text")
    base = F.concat(*[F.col(f"b_{k}") for k in KINDS])
    out = found.filter(text.rlike("[0-9@]")).withColumn("one", F.explode(_found(text, TOKEN, left=True))).withColumn("base", base)
    one = F.col("one")
    seed = F.exists("base", lambda b: (b["s"] < one["e"]) & (b["e"] > one["s"]))
    # A value after '=' or ':' carries its own context: name=value.
    named = one["m"].rlike("^[A-Za-z_]++[=:]")
    pattern = F.when(named, F.regexp_extract(one["m"], "^([A-Za-z_]++[=:])", 1)).otherwise(one["left"])
    pattern = F.lower(F.regexp_replace(pattern, "[0-9]++", "9"))
    return out.select("rid", one["s"].alias("s"), one["e"].alias("e"), pattern.alias("pattern"), _shape(one["m"]).alias("shape"), seed.cast("int").alias("seed"), F.xxhash64(one["m"]).alias("value"))


def score_patterns(inst: DataFrame, rounds: int = 3, least_seeds: int = 3, prior: float = 4.0) -> DataFrame:
    """Confidence per pattern and per shape by alternating over the graph (pattern, shape) -> (n, seeds)."""
    graph = written(inst.groupBy("pattern", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("seeds")), "pii-graph")
    start = graph.groupBy("shape").agg((F.sum("seeds") / (F.sum("n") + F.lit(prior))).alias("score"))
    shapes, patterns = start, None
    for _ in range(rounds):
        edge = graph.join(shapes, "shape")
        patterns = edge.groupBy("pattern").agg(
            ((F.sum(F.col("seeds") + (F.col("n") - F.col("seeds")) * F.col("score"))) / (F.sum("n") + F.lit(prior))).alias("confidence"),
        )
        edge = graph.join(patterns.select("pattern", "confidence"), "pattern")
        shapes = edge.groupBy("shape").agg(
            F.greatest(F.sum("seeds") / (F.sum("n") + F.lit(prior)), (F.lit(1.0) - F.exp(F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999))) * F.col("n")) / (F.sum("n") + F.lit(prior))))).alias("score")
        )
    seen = inst.filter("seed = 1").select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"))
    return patterns.join(seen.filter(F.col("seeds") >= least_seeds), "pattern")


def discover(docs: DataFrame, confidence: float = 0.6, rounds: int = 3) -> DataFrame:
    """rid, text-independent spans: b_<kind> arrays plus b_context, the identifiers that patterns found.
    `docs` has columns doc_id and text; the result has doc_id and the five arrays of struct<s, e>."""
    # The id of a row within one scan of stored files: stable when a task runs again.
    found = spans(docs.select("doc_id", "text")).withColumn("rid", F.monotonically_increasing_id())
    small = written(found.filter(F.col("text").rlike("[0-9@]")).select("rid", "doc_id", "text", *[f"b_{k}" for k in KINDS]), "pii-found")
    inst = written(instances(small), "pii-instances")
    good = score_patterns(inst, rounds).filter(F.col("confidence") >= confidence).select("pattern")
    new = inst.filter(F.col("seed") == 0).join(good, "pattern", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("b_context"))
    bare = [F.transform(f"b_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"b_{k}") for k in KINDS]
    with_data = small.select("rid", "doc_id", *bare).join(new, "rid", "left").drop("rid")
    none = F.array().cast("array<struct<s:int,e:int>>")
    rest = docs.filter(~F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))).select("doc_id", *[none.alias(f"b_{k}") for k in (*KINDS, "context")])
    return with_data.withColumn("b_context", F.coalesce("b_context", none)).unionByName(rest)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = discover(table(spark, sf_dir, "documents"))
    listed = lambda k: F.transform(f"b_{k}", lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    return found.select(
        "doc_id",
        *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[listed(k) for k in KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[listed(k) for k in (*KINDS, "context")]), ",").alias("spans"),
    )
